"""Word lists, patterns, tables and texts that results depend on.

Nothing here is logic. Everything is stated as text, in natural order, so that it
can be compared with the published formats and with the input documents.
"""

# --- Regular-expression building blocks -------------------------------------------------
# Word characters and white space are Unicode-wide. The explicit classes mean the same in
# java.util.regex and RE2, whereas \w, \s and \b do not.
WORD = r"\p{L}\p{N}_"
WS = r"\t-\r\x1c-\x20\x85\p{Z}"
# The characters of WS one by one.
WS_CHARACTERS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
NOT_DIGIT = r"[^\p{Nd}]"
# Word boundaries; the first character of every bounded pattern is a word character.
B0 = rf"(?<![{WORD}])"
B1 = rf"(?![{WORD}])"

# --- Check digits ------------------------------------------------------------------------
# Letter values run from A=10 to Z=35; only the value modulo 10 matters in a sum modulo 10.
ICAO_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ<"
ICAO_VALUES_MOD_10 = "012345678901234567890123450"
# First row of the Verhoeff permutation; row i is this permutation applied i times.
VERHOEFF_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)

# --- Document classes ---------------------------------------------------------------------
PASSPORT = "PASSPORT"
DRIVER_LICENSE = "DRIVER_LICENSE"
AADHAAR = "NATIONAL_ID (AADHAAR)"
PAN = "NATIONAL_ID (PAN)"
VOTER_ID = "VOTER_ID"
NATIONAL_ID = "NATIONAL_ID"
UNKNOWN = "UNKNOWN"

# Tried in this order on the upper-cased text.
DOCUMENT_KEYWORDS = (
    (PASSPORT, ("PASSPORT", "PASSEPORT", "REPUBLIC OF", "DIPLOMATIC PASSPORT")),
    (DRIVER_LICENSE, ("DRIVING LICENCE", "DRIVER LICENSE", "DRIVING LICENSE", "DL NO", "MOTOR VEHICLES")),
    (AADHAAR, ("AADHAAR", "UNIQUE IDENTIFICATION", "MERA AADHAAR", "UIDAI", "GOVERNMENT OF INDIA",
               "GOVERNMENTOFINDIA")),
    (PAN, ("INCOME TAX DEPARTMENT", "PERMANENT ACCOUNT NUMBER", "PAN CARD")),
    (VOTER_ID, ("ELECTION COMMISSION", "VOTER", "ELECTOR", "EPIC")),
    (NATIONAL_ID, ("IDENTITY CARD", "NATIONAL ID", "CITIZEN CARD")),
)
AADHAAR_ROUTE_KEYWORDS = ("AADHAAR", "UIDAI", "UNIQUE IDENTIFICATION", "MERA AADHAAR")
PAN_ROUTE_KEYWORDS = ("PERMANENT ACCOUNT NUMBER",)
MRZ_EXCLUDED_TYPES = ("AADHAAR", "PAN", "DRIVER_LICENSE", "DRIVER LICENSE", "VOTER_ID", "VOTER")

# --- Words that mark a line as a heading, not a name ----------------------------------------
NAME_STOP_WORDS = (
    "GOVERNMENT", "INDIA", "BHARAT", "SARKAR", "UNIQUE", "IDENTIFICATION",
    "AUTHORITY", "AADHAAR", "UIDAI", "ENROLMENT", "MERAAADHAAR", "PEHCHAAN",
    "HELP", "DOWNLOAD", "ISSUE", "VALID", "REPUBLIC", "STATE", "DEPARTMENT",
    "INCOME", "TAX", "PERMANENT", "ACCOUNT", "NUMBER", "ELECTION", "COMMISSION",
    "VOTER", "ELECTOR", "CARD", "MERA", "MERI", "MALE", "FEMALE", "TRANSGENDER",
    "DOB", "YEAR", "BIRTH", "DATE", "ADDRESS", "PIN", "VID",
)
# Words this long are also found inside others, since recognition glues the words of a heading.
GLUED_STOP_WORD_LENGTH = 7
ADDRESS_HEADING_WORDS = NAME_STOP_WORDS[:10]
ADDRESS_BANNED_PHRASES = (
    "1947", "HELP@UIDAI.GOV.IN", "WWW.UIDAI.GOV.IN", "UNIQUE IDENTIFICATION AUTHORITY OF INDIA",
    "ELECTRONICS AND INFORMATION TECHNOLOGY", "GOVERNMENT OF INDIA", "BHARAT SARKAR",
)
ADDRESS_CUT = r"(?i)1947|HELP@|WWW\.|UNIQUE IDENTIFICATION|GOVERNMENT|BHARAT"

# --- Dates ---------------------------------------------------------------------------------
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
MIN_YEAR, MAX_YEAR = 1900, 2030
YEAR = r"(?:19|20)[0-9]{2}"
DATE_DMY = rf"{B0}([0-3]?[0-9])[/\-.]([0-1]?[0-9])[/\-.]({YEAR}){B1}"
DATE_YMD = rf"{B0}({YEAR})[/\-.]([0-1]?[0-9])[/\-.]([0-3]?[0-9]){B1}"
DATE_D_MON_Y = rf"{B0}([0-3]?[0-9])[{WS}]+([A-Z]{{3,9}})[{WS}]+({YEAR}){B1}"
DATE_YEAR = rf"{B0}({YEAR}){B1}"

_NUMERIC = rf"([0-3]?[0-9][/\-.][0-1]?[0-9][/\-.]{YEAR})"
_WORDED = rf"([0-3]?[0-9][{WS}]+[A-Za-z]{{3,9}}[{WS}]+{YEAR})"
DOB_PATTERNS = (
    rf"(?i)(?:DOB|D\.O\.B|D0B|DATE OF BIRTH|BIRTH DATE|BORN|जन्म तिथि)[:{WS}]*{_NUMERIC}",
    rf"(?i)(?:DOB|D\.O\.B|D0B|DATE OF BIRTH)[:{WS}]*{_WORDED}",
    rf"(?i)(?:YEAR OF BIRTH|YOB|जन्म वर्ष)[:{WS}]*({YEAR})",
    rf"(?i){B0}([0-3][0-9][/\-.][0-1][0-9][/\-.]{YEAR}){B1}",
    rf"(?i){B0}([0-3]?[0-9][{WS}]+(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[A-Za-z]*[{WS}]+{YEAR}){B1}",
)
EXPIRY_PATTERNS = (
    rf"(?i)(?:EXPIRY|EXPIRATION|VALID TILL|VALID UPTO|EXP DATE|EXP\. DATE)[:{WS}]*{_NUMERIC}",
    rf"(?i)(?:EXPIRY|EXPIRATION|VALID TILL|VALID UPTO)[:{WS}]*{_WORDED}",
)
ISSUE_PATTERNS = (
    rf"(?i)(?:ISSUE DATE|DATE OF ISSUE|DOI|ISSUED)[:{WS}]*{_NUMERIC}",
    rf"(?i)(?:ISSUE DATE|DATE OF ISSUE)[:{WS}]*{_WORDED}",
)

# --- Document numbers ------------------------------------------------------------------------
AADHAAR_SPACED = rf"{B0}([2-9][0-9]{{3}}[{WS}]+[0-9]{{4}}[{WS}]+[0-9]{{4}}){B1}"
PAN_NUMBER = rf"{B0}([A-Z]{{5}}[0-9]{{4}}[A-Z]){B1}"
PASSPORT_NUMBER = rf"{B0}([A-Z]{{1,2}}[\-]?[0-9]{{7,9}}[A-Z]?){B1}"
PASSPORT_LABEL = rf"(?i)PASSPORT[{WS}]*(?:NO|NUMBER)"
PASSPORT_LABEL_VALUE = rf"[:{WS}]+([A-Z0-9\-]+)"
LICENSE_NUMBER = rf"{B0}([A-Z]{{2}}[\-{WS}]?[0-9]{{2}}[\-{WS}]?{YEAR}[0-9]{{7}}){B1}"
LABELLED_NUMBER = (
    rf"(?i)(?:PASSPORT NO|DOC NO|DOCUMENT NO|LICENSE NO|DL NO|ID NO|ID NUMBER|CARD NO)[:.{WS}]*([A-Z0-9\-/]{{6,20}})"
)
COMPACT_NUMBER = rf"(?i){B0}([A-Z]{{2}}[0-9]{{2}}[0-9]{{7,11}}){B1}"
PIN_CODE = rf"{B0}([1-9][0-9]{{5}}){B1}"

AADHAAR_GROUPED = rf"([2-9][0-9]{{3}}[{WS}.\-_]*[0-9]{{4}}[{WS}.\-_]*[0-9]{{4}})"
AADHAAR_WORD = rf"{B0}([2-9][0-9]{{11}}){B1}"
AADHAAR_RUN = r"([2-9][0-9]{11})"

# --- Person fields -------------------------------------------------------------------------
_PERSON = rf"([A-Za-z{WS}.\-]+)"
NAME_PATTERNS = (
    rf"(?i)(?:NAME|FULL NAME|APPLICANT NAME|CARDHOLDER NAME|नाम)[:{WS}]+{_PERSON}",
    rf"(?i)(?:SURNAME|NOM)[:{WS}]+{_PERSON}",
    rf"(?i)(?:GIVEN NAMES|GIVEN NAME|PRENOMS)[:{WS}]+{_PERSON}",
)
NAME_CUT = (
    r"(?i)DOB|D0B|DATE|SEX|GENDER|NATIONALITY|ID|FATHER|HUSBAND|S/O|W/O|D/O|AADHAAR"
)
DOB_LINE_WORDS = ("DOB", "D0B", "DATE OF BIRTH", "जन्म")
NAME_LINE_ABOVE = rf"^[A-Za-z{WS}.\-]{{3,35}}$"
NAME_LINE_TOP = rf"^[A-Z][A-Za-z{WS}.\-]{{2,30}}$"
NAME_SEARCH_LINES = 8
GENDER_PATTERN = rf"(?i){B0}(?:SEX|GENDER|लिंग)[:{WS}]*([MF]|MALE|FEMALE|TRANSGENDER|PURUSH|MAHILA){B1}"
MALE_WORDS = ("M", "MALE", "PURUSH")
FEMALE_WORDS = ("F", "FEMALE", "MAHILA")
NATIONALITY_PATTERN = rf"(?i){B0}(?:NATIONALITY|CITIZENSHIP|राष्ट्रीयता)[:{WS}]*([A-Za-z]{{3,20}}){B1}"
ADDRESS_PATTERN = (
    rf"(?i)(?:ADDRESS|ADDR|RESIDENCE|पता|C/O|S/O|W/O|D/O)[:{WS}]+([{WORD}{WS},\-/.#]{{10,120}})"
)
MIN_ADDRESS_LENGTH = 10

# --- Structure checks on national identity documents ------------------------------------------
GOVERNMENT_HEADERS = ("GOVERNMENT OF INDIA", "BHARAT SARKAR", "GOVT OF INDIA", "भारत सरकार", "GOVERNMENTOFINDIA")
AUTHORITY_HEADERS = ("UNIQUE IDENTIFICATION", "UIDAI", "AUTHORITY OF INDIA", "भारतीय विशिष्ट पहचान")
AADHAAR_TAGLINES = ("MERA AADHAAR", "MERI PEHCHAAN", "MERAAADHAAR", "AAM AADMI KA ADHIKAR", "आधार", "मेरा आधार")
PAN_HEADERS = ("INCOME TAX", "GOVT OF INDIA", "PERMANENT ACCOUNT NUMBER", "आयकर विभाग")
PAN_ENTITY_TYPES = {
    "P": "Individual / Person", "C": "Company", "H": "Hindu Undivided Family (HUF)",
    "F": "Firm / Partnership", "A": "Association of Persons (AOP)", "T": "Trust",
    "B": "Body of Individuals (BOI)", "L": "Local Authority",
    "J": "Artificial Juridical Person", "G": "Government Agency",
}
PAN_OTHER_ENTITY = "Standard Legal Entity"
AADHAAR_CHECK_NAMES = {
    "format": "Aadhaar 12-Digit Format Check",
    "missing": "Aadhaar 12-Digit Number Check",
    "checksum": "UIDAI Verhoeff Mathematical Checksum",
    "government": "Government of India / Bharat Sarkar Header",
    "authority": "UIDAI Emblem & Authority Text",
    "demographic": "Mandatory Demographic Fields (Name, DOB, Gender)",
    "pin": "Indian 6-Digit Postal PIN Code",
}
PAN_CHECK_NAMES = {
    "syntax": "10-Digit PAN Alphanumeric Syntax",
    "entity": "Taxpayer Entity Categorization",
    "header": "Income Tax Department Sovereign Header",
}

# --- Machine readable zone ----------------------------------------------------------------------
MRZ_KEEP = r"[^A-Z0-9<]"
MRZ_FIRST_LETTERS = ("P", "I", "A", "C", "V")
MRZ_JOINED = rf"(P<[A-Z0-9<]{{38,42}})[{WS}]*([A-Z0-9<]{{40,44}})"
# Place of each field as (line, first character, last character), 1-based and inclusive.
MRZ_LAYOUT = {
    "TD3": {"names": (1, 6, 44), "number": (2, 1, 9), "number_cd": (2, 10, 10), "nationality": (2, 11, 13),
            "dob": (2, 14, 19), "dob_cd": (2, 20, 20), "sex": (2, 21, 21), "expiry": (2, 22, 27),
            "expiry_cd": (2, 28, 28), "optional": (2, 29, 42), "composite_cd": (2, 44, 44)},
    "TD1": {"names": (3, 1, 30), "number": (1, 6, 14), "number_cd": (1, 15, 15), "nationality": (2, 16, 18),
            "dob": (2, 1, 6), "dob_cd": (2, 7, 7), "sex": (2, 8, 8), "expiry": (2, 9, 14),
            "expiry_cd": (2, 15, 15), "composite_cd": (2, 30, 30)},
    "TD2": {"names": (1, 6, 36), "number": (2, 1, 9), "number_cd": (2, 10, 10), "nationality": (2, 11, 13),
            "dob": (2, 14, 19), "dob_cd": (2, 20, 20), "sex": (2, 21, 21), "expiry": (2, 22, 27),
            "expiry_cd": (2, 28, 28)},
}
MRZ_COMPOSITE = {
    "TD3": ((2, 1, 10), (2, 14, 20), (2, 22, 43)),
    "TD1": ((1, 6, 30), (2, 1, 7), (2, 9, 15), (2, 19, 29)),
}
# Width of the lines, number of lines, accepted length of a read line, strict first letters.
MRZ_SIZES = {
    "TD3": (44, 2, 40, 48, "P"), "TD1": (30, 3, 28, 32, "IAC"), "TD2": (36, 2, 34, 38, "IACV"),
}
MRZ_DEFAULT_CODE = {"TD3": "P", "TD1": "I"}
MRZ_CHECK_NAMES = {
    "document_number": "Document Number Check Digit", "dob": "Date of Birth Check Digit",
    "expiry_date": "Expiry Date Check Digit", "composite": "Overall Composite Check Digit",
}

# --- Barcodes -------------------------------------------------------------------------------------
QR_MARKERS = ("PrintLetterBarcodeData", "uid=", "name=")
QR_ATTRIBUTE = rf'([{WORD}]+)[{WS}]*=[{WS}]*"([^"]*)"'
_XML_NAME = rf"[{WORD}:.\-]+"
_XML_VALUE = "(?:\"[^\"<]*\"|'[^'<]*')"
# A single well-formed element, whose attributes are group 2.
XML_ELEMENT = (
    rf"(?s)^[^<]*(?:<\?[^>]*\?>[^<]*)?<({_XML_NAME})((?:[{WS}]+{_XML_NAME}[{WS}]*=[{WS}]*{_XML_VALUE})*)[{WS}]*(?:/>|>.*</\1[{WS}]*>)[{WS}]*$"
)
XML_ATTRIBUTE = rf"({_XML_NAME})[{WS}]*=[{WS}]*({_XML_VALUE})"
XML_REFERENCE = "&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});"
XML_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
PAYLOAD_ID = rf"(?i)(?:DL|ID|NO|NUM)[:{WS}\-]*([A-Z0-9]{{6,14}})"
PAYLOAD_NAME = rf"(?i)(?:NAME|NAM|DAQ)[:{WS}]+([A-Za-z{WS}]+)"
COMPARED = {
    "name": "Applicant Name", "gender": "Gender", "dob": "Date of Birth (DOB / YOB)", "pin": "Postal PIN Code",
    "id": "Document ID Number", "birth": "Date of Birth",
}
MATCH_NOTES = {
    "id": "Matched in payload", "name": "Verified in payload signature", "birth": "DOB timestamp matched",
}

# --- Uploads, sources -----------------------------------------------------------------------------
ALLOWED_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "pdf")
MAX_UPLOAD_BYTES = 30 * 1024 * 1024
SCREENSHOT_NAMES = ("screenshot", "screen_shot", "screen shot", "screencap", "capture_")
SCREENSHOT_SOFTWARE = ("screenshot", "screen", "capture")
SCANNER_SOFTWARE = ("scan", "epson", "canon", "hp", "brother", "camscanner", "scanner")
SOURCE_NAMES = {
    "DIGITAL_PDF": "Digital PDF Document", "SCREENSHOT": "Digital Screen Capture",
    "DIGITAL_IMAGE": "Digital E-Document Export", "SCANNED_DOCUMENT": "Flatbed Scanned Document",
    "PHYSICAL_CAPTURE": "Physical Camera Capture", "E_AADHAAR": "Official e-Aadhaar (Digital)",
    "E_PAN": "Official e-PAN (Digital)", "PASSPORT_SCAN": "Passport (Optical Scan)",
}
# --- Records -----------------------------------------------------------------------------------------
NOT_DETECTED = "Not confidently detected"
DEFAULT_APPLICANT = "Applicant Subject"
DEFAULT_ORGANISATION = "Authorized Institution"
DEFAULT_ORGANISATION_TYPE = "COMPANY"
DEFAULT_OFFICER = "Authorized Officer"
DEFAULT_SOURCE = "Document"
RISK_REASON_TITLES = {
    "verhoeff": "Aadhaar Verhoeff Checksum Failure",
    "mrz": "ICAO 9303 MRZ Checksum Mismatch",
    "barcode": "2D Barcode / Visual OCR Data Discrepancy",
    "surface": "Document Surface Inconsistency (ELA)",
    "face": "Facial Biometric Disparity",
    "liveness": "Biometric Liveness Challenge Incomplete",
    "passed": "All Multi-Modal Security Verifications Passed",
    "recapture": "Document Image Recapture Required",
}
BREAKDOWN_NAMES = {
    "tamper": "Document Authenticity (ELA)", "consistency": "Data Consistency & Checksums",
    "face": "Biometric Face Match", "liveness": "Active 3D Liveness", "quality": "Optical Clarity & DPI",
}
FAILED_REGION = {"id": "sr_1", "title": "Checksum / Structural Forgery", "severity": "HIGH", "type": "FONT_MISMATCH"}
FAILED_REGION_BOX = {"x": 20, "y": 40, "width": 60, "height": 30}
SUBMISSION_STATUS = "EVIDENCE_PREPARED_FOR_INVESTIGATOR_REVIEW"
ESCALATE = "REJECT / ESCALATE TO CYBER CELL"
MANUAL_REVIEW_REQUIRED = "MANUAL REVIEW REQUIRED"

# --- Face mesh points used by the eye aspect ratio and the head yaw -----------------------------------
LEFT_EYE = {"outer": 33, "inner": 133, "up1": 160, "up2": 158, "low1": 144, "low2": 153}
RIGHT_EYE = {"outer": 263, "inner": 362, "up1": 385, "up2": 387, "low1": 380, "low2": 373}
NOSE_TIP, LEFT_TEMPLE, RIGHT_TEMPLE = 1, 234, 454
NEXT_CHALLENGE = {
    "DETECT_FACE": "BLINK_TWICE", "BLINK_TWICE": "TURN_LEFT", "TURN_LEFT": "TURN_RIGHT",
    "TURN_RIGHT": "COMPLETE", "COMPLETE": "COMPLETE",
}
