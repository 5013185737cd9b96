"""Thresholds, limits and texts that decide results."""

ROTATIONS = (0, 90, 180, 270)

# Orientation
MIN_LINE_CONF = 0.6
UPRIGHT_ASPECT = 0.8
LOW_SCORE = 5.0
ZERO_MARGIN = 2.0
AMBIGUOUS_RATIO = 0.25
BLANK_INK = 0.002
SKEW_REPORT_DEGREES = 0.75
SKEW_MAX_DEGREES = 20.0
DESKEW_MIN_DEGREES = 0.1
RENDER_DPI = 100.0
POINTS_PER_INCH = 72.0

# Text layer
LAYER_HEIGHT = 0.9
MIN_FONT_SIZE = 0.5
MAX_FONT_SIZE = 100.0
# Advance widths of Helvetica in thousandths of its size, from its published
# metrics, for the characters of Windows-1252. Any other character is shown as a middle dot.
GLYPH_WIDTHS = {
    191: "'",
    222: "ijl\u2018\u2019\u201a",
    260: "|\u00a6",
    278: " !,./:;I[\\]ft\u00a0\u00b7\u00cc\u00cd\u00ce\u00cf\u00ec\u00ed\u00ee\u00ef",
    333: "()-`r\u00a1\u00a8\u00ad\u00af\u00b2\u00b3\u00b4\u00b8\u00b9\u02c6\u02dc\u201c\u201d\u201e\u2039\u203a",
    334: "{}",
    350: "\u2022",
    355: '"',
    365: "\u00ba",
    370: "\u00aa",
    389: "*",
    400: "\u00b0",
    469: "^",
    500: "Jcksvxyz\u00e7\u00fd\u00ff\u0161\u017e",
    537: "\u00b6",
    556: "#$0123456789?L_abdeghnopqu\u00a2\u00a3\u00a4\u00a5\u00a7\u00ab\u00b5\u00bb\u00e0\u00e1\u00e2\u00e3\u00e4\u00e5"
         "\u00e8\u00e9\u00ea\u00eb\u00f0\u00f1\u00f2\u00f3\u00f4\u00f5\u00f6\u00f9\u00fa\u00fb\u00fc\u00fe\u0192\u2013\u2020\u2021\u20ac",
    584: "+<=>~\u00ac\u00b1\u00d7\u00f7",
    611: "FTZ\u00bf\u00df\u00f8\u017d",
    667: "&ABEKPSVXY\u00c0\u00c1\u00c2\u00c3\u00c4\u00c5\u00c8\u00c9\u00ca\u00cb\u00dd\u00de\u0160\u0178",
    722: "CDHNRUw\u00c7\u00d0\u00d1\u00d9\u00da\u00db\u00dc",
    737: "\u00a9\u00ae",
    778: "GOQ\u00d2\u00d3\u00d4\u00d5\u00d6\u00d8",
    833: "Mm",
    834: "\u00bc\u00bd\u00be",
    889: "%\u00e6",
    944: "W\u0153",
    1000: "\u00c6\u0152\u2014\u2026\u2030\u2122",
    1015: "@",
}
OTHER_GLYPH_WIDTH = 278

# Markdown
TABLE_MIN_CELLS = 3
HEADING_RATIO = 1.25
TOP_HEADING_FACTOR = 1.2
COLUMN_TOLERANCE = 0.04
ROW_TOLERANCE = 0.6
EMPTY_PAGE_TEXT = "_No text recognised on this page._"

# Review
REASON_RANK = {
    "ambiguous": 0,
    "close_to_zero": 1,
    "skewed": 2,
    "error": 3,
    "blank": 4,
    "no_text": 5,
}
OTHER_RANK = 9
REASON_LABELS = {
    "no_text": "No readable text found at any rotation",
    "close_to_zero": "Barely beat leaving the page unrotated",
    "ambiguous": "Two rotations scored almost the same",
    "error": "Page failed to process",
    "blank": "Page appears to be blank",
    "skewed": "Page is tilted and may need straightening",
}
OTHER_LABEL = "Uncertain"
REASON_HINTS = {
    "no_text": "Usually image-only scans. If the samples look upright, accept them all.",
    "close_to_zero": "The model nearly left these alone. Check a few samples before accepting.",
    "ambiguous": "The riskiest group - the top two rotations were close. Worth reviewing individually.",
    "error": "These pages could not be analysed and were left unchanged.",
    "blank": "Almost no ink detected. Usually separator sheets or scanning artefacts - often safe to accept, or drop them.",
    "skewed": "Orientation is correct but the scan is tilted. Rotation is right; the tilt needs straightening.",
}
OTHER_HINT = ""
MAX_WINDOW = 100
MAX_SAMPLES = 12
GROUPS_THRESHOLD = 20
BULK_ACTIONS = ("accept_all", "rotate_all")
GROUP_ACTIONS = ("accept", "rotate", "deskew")

# Jobs and uploads
NO_FILES_ERROR = "No files were uploaded."
ALL_FAILED_ERROR = "None of the files could be processed."
NOTHING_TO_COMMIT = "No completed PDF files to process"
MB = 1024 * 1024
MAX_FILE_BYTES = 2048 * MB
MAX_CHUNK_BYTES = 16 * MB
MAX_FILES_PER_UPLOAD = 1000
UPLOAD_STATUS_RANK = {
    "failed": 0,
    "invalid": 1,
    "retrying": 2,
    "uploading": 3,
    "queued": 4,
    "done": 5,
}

# Progress
RATE_WINDOW = 30
IDLE_SECONDS = 30 * 60
STATE_TTL_DAYS = 7
SPEED_WINDOW_SECONDS = 10
SPEED_MIN_SPAN_SECONDS = 2

# Library
RETENTION_HOURS = 24
DASHBOARD_JOBS = 50
RECENT_JOBS = 5
HISTORY_JOBS = 20
COMPARE_PAGES_PER_FILE = 20
COMPARE_PAGES_PER_JOB = 40

# Whitespace as text splitting and trimming understand it (Unicode White_Space plus
# the four separator controls U+001C..U+001F).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
