"""Fixed values the rules depend on: extension lists, term lists, patterns, code tables."""

import mimetypes

# --- fixed values: file extensions by type -----------------------------------
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".tiff", ".gif", ".bmp", ".webp"]
DOCUMENT_EXTENSIONS = [".pdf", ".docx", ".doc", ".xlsx", ".xls", ".pptx", ".ppt", ".odt", ".ods", ".odp"]
AUDIO_EXTENSIONS = [".mp3", ".wav", ".flac", ".m4a", ".ogg", ".aac"]
VIDEO_EXTENSIONS = [".mp4", ".avi", ".mkv", ".mov", ".wmv"]
EXECUTABLE_EXTENSIONS = [".exe", ".dll", ".so", ".dylib"]

FILE_TYPES = {
    "image": IMAGE_EXTENSIONS,
    "document": DOCUMENT_EXTENSIONS,
    "audio": AUDIO_EXTENSIONS,
    "video": VIDEO_EXTENSIONS,
    "executable": EXECUTABLE_EXTENSIONS,
}

# --- fixed values: MIME fragments that select an extractor -------------------
DOCUMENT_MIMES = [
    "application/pdf", "application/msword", "application/vnd.openxmlformats",
    "application/vnd.ms-excel", "application/vnd.ms-powerpoint",
]
EXECUTABLE_MIMES = [
    "application/x-executable", "application/x-msdos-program", "application/x-msdownload",
    "application/x-sharedlib", "application/x-mach-binary",
]

# --- fixed values: zip family ------------------------------------------------
ZIP_EXTENSIONS = [
    ".docx", ".xlsx", ".pptx", ".odt", ".ods", ".odp", ".jar", ".war", ".ear",
    ".apk", ".xpi", ".crx", ".epub", ".zip",
]
ZIP_MIMES = ["zip", "vnd.openxmlformats", "vnd.oasis.opendocument"]
ZIP_MAGIC = "504B0304"

# --- fixed values: executable magic numbers ----------------------------------
PE_MAGIC = "4D5A"
ELF_MAGIC = "7F454C46"
MACHO_MAGICS = ["FEEDFACE", "FEEDFACF", "CAFEBABE"]

# --- fixed values: first bytes of common formats (hex), and bytes 5 to 8 of MP4 ---
CONTENT_MAGICS = {
    "25504446": "application/pdf", "FFD8FF": "image/jpeg", "89504E470D0A1A0A": "image/png", "47494638": "image/gif",
    "504B0304": "application/zip", "4D5A": "application/x-msdownload", "7F454C46": "application/x-executable",
    "494433": "audio/mpeg",
}
MP4_BRAND = "66747970"

# --- fixed values: text file suffixes ----------------------------------------
TEXT_FORMATS = {
    ".json": "JSON", ".xml": "XML", ".html": "HTML", ".htm": "HTML", ".csv": "CSV",
    ".md": "Markdown", ".py": "Python", ".js": "JavaScript", ".css": "CSS",
    ".c": "C/C++", ".cpp": "C/C++", ".h": "C/C++", ".java": "Java",
}

# --- fixed values: MIME types and the extensions they go with ----------------
MIME_TO_EXTENSIONS = {
    "image/jpeg": [".jpg", ".jpeg"],
    "image/png": [".png"],
    "application/pdf": [".pdf"],
    "text/plain": [".txt", ".text"],
    "application/msword": [".doc"],
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": [".docx"],
    "audio/mpeg": [".mp3"],
    "video/mp4": [".mp4"],
}

# --- fixed values: detection patterns ----------------------------------------
GPS_TERMS_PATTERN = r"GPS|geotag|location"
EMAIL_PATTERN = r"([a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)"
PHONE_PATTERN = r"\b(?:\+\d{1,2}\s)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b"
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
DOMAIN_PATTERN = (
    r"(?<!\w)(?:https?://)?(?:www\.)?"
    r"([a-zA-Z0-9][-a-zA-Z0-9]*\.[a-zA-Z0-9]{2,}(?:\.[a-zA-Z0-9]{2,})*)(?!\w)"
)
IPV4_PATTERN = (r"\b(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
                r"\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b")
IPV6_PATTERN = r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
CARD_PATTERN = r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"
API_KEY_PATTERN = r"\b([a-zA-Z0-9]{20,40})\b"
URL_PATTERN = r"https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+[^\s,.)]*"

# --- fixed values: term lists ------------------------------------------------
COMMON_DOMAINS = [
    "google.com", "microsoft.com", "apple.com", "adobe.com",
    "amazon.com", "facebook.com", "twitter.com", "github.com",
]
API_KEY_FIELDS = ["key", "token", "api", "secret", "password", "auth", "credential"]
EMPTY_MD5 = "d41d8cd98f00b204e9800998ecf8427e"
SMALL_TEXT_EXTENSIONS = [".txt", ".md", ".csv", ".json"]
ARCHIVE_EXECUTABLE_EXTENSIONS = [".exe", ".dll", ".so", ".sh", ".bat", ".ps1", ".vbs"]
PLAIN_ENCODINGS = ["utf-8", "ascii"]

GPS_KEYS = ["GPSInfo", "GPS"]
IMAGE_DEVICE_KEYS = ["Make", "Model", "Software", "ProcessingSoftware"]
IMAGE_DATE_KEYS = ["DateTime", "DateTimeOriginal", "DateTimeDigitized", "ModifyDate"]
IPTC_CONTACT_KEYS = ["By-line", "Credit", "Source", "Writer-Editor", "Contact"]
EDITOR_KEYS = ["Software", "ProcessingSoftware", "CreatorTool"]
EDITOR_NAMES = ["photoshop", "gimp", "lightroom", "affinity"]

PDF_AUTHOR_KEYS = ["Author", "Creator", "Producer", "LastModifiedBy"]
OFFICE_AUTHOR_KEYS = ["author", "creator", "last_modified_by"]
DOCUMENT_SOFTWARE_KEYS = ["Creator", "Producer", "creator", "producer", "application"]
DOCUMENT_DATE_KEYS = ["CreationDate", "ModDate", "created", "modified"]
REVISION_KEYS = ["version", "revision", "revisions"]

AUDIO_PERSONAL_TERMS = ["artist", "composer", "albumartist", "author", "encoder", "performer"]
AUDIO_GEO_TERMS = ["geotag", "location", "latitude", "longitude", "geo"]
AUDIO_DEVICE_TERMS = ["encoder", "encodedby", "encoding", "source", "device", "tool"]
AUDIO_COPYRIGHT_TERMS = ["copyright", "rights", "license"]
AUDIO_ID_TERMS = ["isrc", "barcode", "catalog", "upc", "isbn"]
AUDIO_LYRIC_TERMS = ["lyric", "text"]

VIDEO_DATE_TERMS = ["date", "time", "created"]
VIDEO_GEO_TERMS = ["geo", "gps", "location", "latitude", "longitude"]
VIDEO_DEVICE_TERMS = ["device", "camera", "make", "model"]
VIDEO_SOFTWARE_TERMS = ["software", "encoder", "handler", "application"]
VIDEO_COPYRIGHT_TERMS = ["copyright", "license", "rights"]
COMMON_CODECS = ["h264", "h.264", "avc", "h265", "h.265", "hevc", "vp9", "av1", "mpeg4", "mpeg2"]

SUSPICIOUS_IMPORT_TERMS = [
    "inject", "hook", "crypt", "keylog", "screen", "exploit",
    "hide", "stealth", "spy", "capture", "password",
]
SUSPICIOUS_RESOURCES = ["BINARY", "HTML", "RCDATA", "UNKNOWN"]

# --- fixed values: audio tag names -------------------------------------------
ID3_FRAMES = {
    "TIT2": "title", "TPE1": "artist", "TALB": "album", "TDRC": "year", "TCON": "genre",
    "TRCK": "track", "COMM": "comment", "TCOM": "composer", "TPUB": "publisher",
    "TCOP": "copyright", "TENC": "encoded_by", "WXXX": "url", "TPOS": "disc", "TBPM": "bpm",
    "TSRC": "isrc", "TMED": "media_type", "TCMP": "compilation",
}
MP4_ATOMS = {
    "©nam": "title", "©ART": "artist", "©alb": "album", "©day": "year", "©gen": "genre",
    "trkn": "track", "©wrt": "composer", "cprt": "copyright", "©too": "encoded_by",
    "disk": "disc", "tmpo": "bpm", "cpil": "compilation",
}
MP4_COVER_ATOM = "covr"

# --- fixed values: binary header codes ---------------------------------------
PE_MACHINES = {0x014C: "x86 (32-bit)", 0x0200: "IA64", 0x8664: "x64 (AMD64)"}
PE_SUBSYSTEMS = {
    1: "Native", 2: "Windows GUI", 3: "Windows Console",
    5: "OS/2 Console", 7: "POSIX Console", 9: "Windows CE GUI",
}
MACHO_FILE_TYPES = {
    0x1: "OBJECT", 0x2: "EXECUTE", 0x3: "FVMLIB", 0x4: "CORE", 0x5: "PRELOAD", 0x6: "DYLIB",
    0x7: "DYLINKER", 0x8: "BUNDLE", 0x9: "DYLIB_STUB", 0xA: "DSYM", 0xB: "KEXT_BUNDLE",
}

# --- fixed values: redaction field lists -------------------------------------
DOCX_BLANKED = ["title", "subject", "comments", "category", "keywords"]
XLSX_BLANKED = ["title", "subject", "description", "category", "keywords"]

SEVERITIES = ["high", "medium", "low"]
FINDING_TYPES = ["privacy", "security", "consistency", "information", "error"]


def mime_table():
    """Extension -> MIME type, from the interpreter's built-in registry (no system files)."""
    registry = mimetypes.MimeTypes()
    return dict(registry.types_map[1])


def mime_suffixes():
    """Combined suffixes such as .tgz, and their long form."""
    return dict(mimetypes.MimeTypes().suffix_map)


def mime_encodings():
    """Compression suffixes, which are stripped before the type lookup."""
    return dict(mimetypes.MimeTypes().encodings_map)
