"""Patterns of the letter fields.

Fixed values: each must find what the rules are defined with, and is spelled as they spell it. Both the column expressions and
the SQL that checks them take the patterns from here; how they are used, in which order and with what rejected, is each one's own.
"""

# Dates.
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DAY = r"\d{1,2}(?:st|nd|rd|th)?"
YEAR = r"(?:\d{4}|\d{2})"
DATE_TOKEN = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]" + YEAR + "|" + DAY + r"[\s\-\.]+" + MONTH + r"[\s\-\.,]+" + YEAR + "|" + MONTH + r"[\s\-\.,]+" + DAY + r"[\s\-\.,]+" + YEAR + ")"
DATE = r"(?i)\b(" + DATE_TOKEN + r")\b"
DATE_LINE = r"^[Dd]ate\s*[:\-]\s*(.+)$"
JOINING_LABEL = r"(?i)(?:Date\s+of\s+Joining|Joining\s+Date|Expected\s+Joining\s+Date|Joining\s+On|Expected\s+to\s+Join|Date\s+of\s+Commencement)\s*[:\-|]?\s*(" + DATE_TOKEN + ")"

# Contacts.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
EMAIL_PERMISSIVE = r"[A-Za-z0-9._%+\-]+\s*@\s*[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
EMAIL_AFTER_DEAR = r"(?i)dear\s+([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"
EMAIL_DOMAIN = r"^[a-z0-9][a-z0-9.\-]*\.[a-z]{2,}$"
SITE_DOMAIN = r"(?:https?://)?(?:www\.)?([A-Za-z0-9][A-Za-z0-9.\-]*\.[A-Za-z]{2,})"
BARE_DOMAIN = r"(?i)\b([a-z0-9][a-z0-9\-]{2,}\.(com|in|co\.in|org\.in|net|org))\b"
WEBSITE_LABELLED = r"(?i)(?:Website|Web|URL|www)[:\s]+((?:https?://)?(?:www\.)?[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?:/[^\s]*)?)"
WEBSITE_BARE = r"(?i)(www\.[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?:/[^\s]*)?)"
WEBSITE_OTHER = r"(?i)(?:site|domain)[:\s]+([A-Za-z0-9.\-]+\.[A-Za-z]{2,})"
PHONE = r"(?:\+91[\s\-]?)?(?:\(0\d{2,4}\)[\s\-]?)?\d{10}|(?:\+91[\s\-]?)?\d{5}[\s\-]\d{5}"
COMPANY_NUMBER = r"\b([LU]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6})\b"
TAX_NUMBER = r"\b(\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d])\b"
SMALL_FIRM_NUMBER = r"(?i)\b(UDYAM-[A-Z]{2}-\d{2}-\d{7})\b"

# Companies.
COMPANY_LINE = (
    r"(?i)^([A-Za-z0-9 &\.\'\-]{2,60}(?:Pvt\.?\s*Ltd\.?|Private\s+Limited|Public\s+Limited|Limited|LLP|LLC|Inc\.?|Corp\.?|Corporation|Industries|Solutions|"
    r"Technologies|Tech|Services|Consulting|Foundation|Trust|Enterprises|Associates|Group|Holdings)\.?)\s*$"
)
COMPANY_SIGNED = r"(?i)\bFor\s+([A-Za-z][A-Za-z0-9 &\.\-\']{2,60}(?:Pvt\.?\s*Ltd\.?|Limited|LLP|Inc\.?|Corp\.?|Technologies|Solutions|Services|Foundation|Trust)\.?)"
COMPANY_LABELLED = r"(?i)(?:Company\s+Name|Organisation|Organization)\s*[:\-]\s*([^\n]{3,80})"
COMPANY_BEFORE_NUMBER = r"(?i)(?:CIN|GSTIN|GST\s*No)\s*[:\s#]+([A-Z0-9]{15,21})"
COMPANY_TITLE = r"^[A-Za-z][A-Za-z0-9 &\.\'\-]+$"
NOT_COMPANY_LINE = r"(?i)^(Dear|To|Date|Ref|Subject|From)"
NOT_COMPANY_TITLE = r"(?i)^(Dear|To|Date|Ref|Subject|From|Re)"
COMPANY_SIGNS = r"[!/|@]"
COMPANY_STOPS = r"[,;]"
PIN = r"\b\d{6}\b"
CODE = r"^[A-Z0-9 \-]+$"

# People and roles.
NAME_AFTER_DEAR = r"\bDear[ \t]+(?:Mr\.?|Ms\.?|Mrs\.?|Dr\.?|Prof\.?)?[ \t]*([A-Z][a-zA-Z]+(?:[ \t]+[A-Z][a-zA-Z]*){0,3})"
NAME_LABELLED = r"(?:Candidate|Employee|Applicant)?[ \t]*Name[ \t]*[:\-][ \t]*([A-Z][a-zA-Z]+(?:[ \t]+[A-Z][a-zA-Z]*){0,3})"
NAME_AFTER_TO = r"\bTo,?\s*\n\s*([A-Z][a-zA-Z]+(?:[ \t]+[A-Z][a-zA-Z]+){1,3})"
DESIGNATION_END = r"\s{2,}|\bdate\b\s*:|\bref\b"
TITLES = [
    r'(?:position|role|post|designation)\s+of\s*["“]([^"”\n]{3,60})["”]',
    r"(?:Position|Designation|Role|Post|Job\s+Title|Job\s+Profile)\b\s*(?::\s*|[-–]\s+)([^\n,;]{3,70})",
    r"(?:you\s+(?:will\s+be|are)\s+(?:joining|appointed|hired|engaged)\s+as\s+(?:a\s+|an\s+)?)([A-Za-z][^\n,;\.]{3,50})",
    r'(?:position|role|post|designation)\s+of\s+["“]?([A-Za-z][^\n,;\.\(\)"”]{2,50}?)(?:["”]|\s*\n|\s*\(|\s*with\s)',
    r'(?:offer(?:ed)?\s+(?:you\s+)?(?:the\s+)?(?:position|role|post)\s+of\s+)["“]?([A-Za-z][^\n,;\.]{3,50})',
    r"(?:appointed|joining|hired|engaged)\s+as\s+(?:a\s+|an\s+)?([A-Z][a-zA-Z\s]{3,50})(?:\s+in|\s+at|\s+for|\s+with|\n|,)",
]
TITLE_END = r"\s+(?:subject\s+to|effective|commencing|w\.e\.f|with\s+effect)"
TITLE_SIGNS = r"[:;.]"
EMPLOYMENT_TYPES = [
    (r"\binternship\b|\bstipend\b", "Internship"),
    (r"\btrainee\b|\btraineeship\b|\bgraduate\s+trainee\b", "Trainee"),
    (r"\bapprentice\b", "Apprentice"),
    (r"\bfixed.?term\b|\bcontract(?:ual)?\b", "Contract"),
    (r"\bpart.?time\b", "Part-time"),
    (r"\bconsultant\b|\bconsultancy\b|\bfreelance\b", "Consultant"),
    (r"\bpermanent\b|\bfull.?time\b|\bregular\s+employment\b", "Full-time"),
]
LOCATION = r"(?i)(?:Work\s+Location|Place\s+of\s+(?:Work|Posting|Duty)|Location|Based\s+[Aa]t|Office\s+Location|Duty\s+Station|Posting\s+Location)\s*[:\-]\s*([^\n,;]{3,60})"
NOT_LETTERS = r"[^A-Za-z0-9]"
HR_LABEL = r"(?i)\b(HR\s+(?:Manager|Head|Director|Executive|Officer)|Human\s+Resources?|Head\s+of\s+HR|Chief\s+Human|Talent\s+Acquisition|Recruitment\s+(?:Manager|Head)|People\s+(?:Operations|Manager)|CHRO|HRD)\b"
SIGN_OFF = r"(?i)(?:Yours\s+(?:sincerely|faithfully|truly)|Regards|Thanks\s+and\s+regards|With\s+regards|Best\s+regards|Warm\s+regards)"
FOR_COMPANY = (
    r"(?i)For[ \t]+[A-Z][A-Za-z0-9 &\.\-\']{2,60}(?:Pvt\.?\s*Ltd\.?|Private\s+Limited|Limited|LLP|Inc\.?|Corp\.?|Technologies|Solutions|Services|Foundation|Trust|Enterprises|Group)\.?"
    r"[ \t]*\n[ \t]*([A-Z][a-zA-Z]+(?:[ \t]+[A-Z][a-zA-Z]+){1,4})[ \t]*\n[ \t]*([A-Za-z][^\n]{3,70})"
)
SIGNATORY = r"(?i)(Authoris\w*\s+Signatory|Authoriz\w*\s+Signatory)"
SIGNED_NAME = r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}$"

# Amounts.
AMOUNT = r"(?i)(?:₹|Rs\.?|INR)?\s*([\d,]+(?:\.\d{1,2})?)\s*(?:(lakhs?|lacs?|lpa|crores?|cr)\b)?"
