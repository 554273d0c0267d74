"""Rules over PE, ELF and Mach-O headers."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from metaudit.functions import constants as K
from metaudit.functions.findings import Items, contains_any, finding, fires, fires_on, nonempty
from metaudit.operators.rulebook import Pack

PACK = Pack("executable", "executable")


def _sections(rec) -> Column:
    return F.coalesce(rec.section("sections"), rec.section("file_headers")["sections"])


@PACK.rule
def exe_type(rec) -> Column:
    kind = rec.section("file_headers")["type"]
    return fires(kind.isNotNull(), finding(
        "exe_type", "information", "low", F.concat(F.lit("Executable type: "), kind), executable_type=kind))


@PACK.rule
def exe_high_entropy(rec) -> Column:
    packed = F.filter(_sections(rec), lambda s: s["entropy"] > 7.0)
    return fires_on(packed, lambda items: F.size(items) > 0, lambda items: finding(
        "exe_high_entropy", "security", "high", "High entropy sections detected (possible packing/encryption)",
        sections=Items(F.transform(items, lambda s: s["name"]))))


@PACK.rule
def exe_suspicious_imports(rec) -> Column:
    def suspicious(name):
        return F.coalesce(contains_any(name, K.SUSPICIOUS_IMPORT_TERMS), F.lit(False))

    libraries = F.filter(F.transform(rec.section("libraries"), lambda l: l["name"]), suspicious)

    def of_import(dll):
        functions = F.filter(F.coalesce(dll["imports"], F.array().cast("array<string>")), suspicious)
        return F.concat(
            F.filter(F.array(dll["name"]), suspicious),
            F.transform(functions, lambda f: F.concat(dll["name"], F.lit(":"), f)))

    named = F.filter(rec.section("imports"), lambda d: d["name"].isNotNull())
    none = F.array().cast("array<string>")
    found = F.concat(F.coalesce(libraries, none), F.coalesce(F.flatten(F.transform(named, of_import)), none))
    return fires_on(found, lambda items: F.size(items) > 0, lambda items: finding(
        "exe_suspicious_imports", "security", "high", "Potentially suspicious libraries or imports detected",
        suspicious_items=Items(items)))


@PACK.rule
def exe_signature(rec) -> Column:
    signature = rec.section("signatures")
    signed, verified = F.coalesce(signature["signed"], F.lit(False)), F.coalesce(signature["verified"], F.lit(False))

    def status(*texts):
        return F.when(signed & verified, texts[0]).when(signed, texts[1]).otherwise(texts[2])

    return fires(signature.isNotNull(), finding(
        "exe_signature", "security", status("low", "medium", "medium"),
        status("Executable is digitally signed and verified", "Executable is signed but not verified",
               "Executable is not digitally signed"),
        signature=status("verified", "unverified", "unsigned")))


@PACK.rule
def exe_compile_time(rec) -> Column:
    built = nonempty(F.coalesce(rec.section("file_headers")["compile_time"], rec.section("pe_info")["compile_time"]))
    return fires(built.isNotNull(), finding(
        "exe_compile_time", "information", "low", F.concat(F.lit("Compilation timestamp: "), built),
        compile_time=built))


@PACK.rule
def exe_section_names(rec) -> Column:
    # every standard name starts with a dot, so the dot test alone decides
    odd = F.filter(F.transform(_sections(rec), lambda s: s["name"]), lambda n: ~n.startswith("."))
    return fires_on(odd, lambda items: F.size(items) > 0, lambda items: finding(
        "exe_section_names", "security", "medium", "Non-standard section names detected", sections=Items(items)))


@PACK.rule
def exe_dotnet(rec) -> Column:
    return fires(rec.section("pe_info")["is_dotnet"], finding(
        "exe_dotnet", "information", "low", ".NET assembly detected", dotnet=True))


@PACK.rule
def exe_resources(rec) -> Column:
    found = F.filter(rec.section("resources"), lambda r: r.isin(K.SUSPICIOUS_RESOURCES))
    return fires_on(found, lambda items: F.size(items) > 0, lambda items: finding(
        "exe_resources", "security", "medium", "Potentially suspicious resources embedded in executable",
        resources=Items(items)))


@PACK.rule
def exe_shared_libs(rec) -> Column:
    linked = F.transform(
        F.filter(rec.section("dynamic"), lambda d: d["type"] == "shared_library"), lambda d: d["name"])
    return fires_on(linked, lambda items: F.size(items) > 0, lambda items: finding(
        "exe_shared_libs", "information", "low",
        F.concat(F.lit("Executable dynamically links to "), F.size(items), F.lit(" libraries")),
        libraries=Items(items)))


@PACK.rule
def exe_rpath(rec) -> Column:
    paths = F.transform(
        F.filter(rec.section("dynamic"), lambda d: d["type"].isin("DT_RPATH", "DT_RUNPATH")), lambda d: d["value"])
    return fires_on(paths, lambda items: F.size(items) > 0, lambda items: finding(
        "exe_rpath", "security", "medium", "Executable uses custom library search paths (RPATH/RUNPATH)",
        paths=Items(items)))


@PACK.rule
def exe_universal(rec) -> Column:
    headers = rec.section("macho_info")["headers"]
    return fires(F.size(headers) > 1, finding(
        "exe_universal", "information", "low",
        F.concat(F.lit("Universal binary with "), F.size(headers), F.lit(" architectures")),
        architectures=Items(F.transform(headers, lambda h: F.coalesce(h["cpu_type"], F.lit("unknown"))))))
