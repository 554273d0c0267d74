"""A pack is an ordered set of named rules for one file type (or for all)."""


class Pack:
    def __init__(self, name: str, file_type: str | None = None):
        self.name = name
        self.file_type = file_type  # None: every type
        self.rules = {}
        self.broken = None  # optional Record -> Column: text of the problem when a record cannot be judged

    def rule(self, function):
        self.rules[function.__name__] = function
        return function

    def fails_when(self, function):
        self.broken = function
        return function

    def applies(self, record):
        return None if self.file_type is None else record.type.eqNullSafe(self.file_type)
