"""Settings of the letter rules."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# They must equal what the rules are defined with.
RED_PHRASES = [
    "processing fee", "registration fee", "security deposit", "transfer the amount", "pay to confirm", "Western Union", "wire transfer",
    "kindly deposit", "refundable deposit", "courier charges", "training fee", "medical fee to be paid", "provide bank details",
    "bank account number", "do not share this letter", "keep this offer confidential", "do not contact hr", "do not verify with hr",
    "do not reach out to company", "verify with your company", "confirm by clicking", "valid for 24 hours", "expires in 24 hours",
    "limited time offer", "respond immediately", "confirm immediately", "accept within 24 hours", "send your details to claim",
    "failure to respond will result in legal action", "legally binding offer letter", "dummy offer",
    "will call you with the joining details", "collect from office after joining",
]
TEMPLATE_ARTIFACTS = ["[candidate name]", "[your name]", "[name]", "[address]", "[date]", "[position name]", "[reference number]", "[salary]", "[department]", "[company name]"]
FREE_MAIL = ["gmail.com", "yahoo.com", "yahoo.co.in", "outlook.com", "hotmail.com", "live.com", "rediffmail.com", "protonmail.com", "icloud.com", "aol.com"]
JOINING_KEYWORDS = [
    "joining date", "date of joining", "join on", "joining on", "report on", "report to duty", "reporting date", "commencement", "start date",
    "starting from", "effective from", "with effect from", "w.e.f", "date of commencement", "expected to join", "you are expected to report",
]
OFFER_KEYWORDS = ["dated:", "date of issue", "issue date", "letter date"]
SALARY_KEYWORDS = {
    "ctc": ["ctc", "cost to company", "total fixed pay", "tfp", "annual package", "annual ctc", "annual salary", "gross annual", "total annual", "total compensation"],
    "gross": ["gross monthly", "gross salary", "gross pay", "total gross", "gross per month", "monthly gross"],
    "net": ["net monthly", "net pay", "take home", "take-home", "in hand", "net salary"],
    "basic": ["basic salary", "basic pay", "basic"],
    "hra": ["hra", "house rent allowance"],
    "pf_employee": ["employee's pf", "employee pf", "pf employee", "epf employee"],
    "pf_employer": ["employer's pf", "employer pf", "pf employer", "epf employer"],
    "special": ["special allowance", "other allowance", "variable allowance"],
    "gratuity": ["gratuity"],
    "joining_bonus": ["joining bonus", "sign-on bonus", "sign on bonus", "joining incentive"],
}
# Fixed values of the extraction: words that name or rule out a value.
GENERIC_DOMAINS = ["gmail.com", "yahoo.com", "yahoo.co.in", "outlook.com", "hotmail.com", "live.com", "rediffmail.com"]
SUFFIX_WORDS = [
    "pvt", "ltd", "limited", "llp", "inc", "corp", "corporation", "industries", "solutions", "technologies", "services", "consulting", "enterprises", "group",
    "holdings", "associates", "ventures", "systems", "foundation", "trust", "company", "co",
]
JOB_LEADS = [
    "associate", "executive", "trainee", "officer", "manager", "analyst", "intern", "engineer", "consultant", "specialist", "assistant", "coordinator", "senior",
    "junior",
]
SENTENCE_WORDS = [
    "during", "employment", "with", "the", "your", "our", "you", "will", "may", "be", "transferred", "any", "operating", "office", "or", "and", "but", "that",
    "this", "these", "those", "from", "into", "by", "for", "at", "on", "in", "is", "are", "was", "were", "have", "has", "had", "all", "which", "who", "when",
    "where", "how", "if", "not", "an", "as", "it", "its",
]
NOT_COMPANIES = [
    "privileged & confidential", "privileged and confidential", "private & confidential", "private and confidential", "strictly confidential", "confidential",
    "accepted and agreed", "without prejudice", "human resources", "human resource", "hr department", "offer letter", "appointment letter", "employment letter",
    "terms and conditions", "terms & conditions", "offer of employment", "offer of appointment", "letter of intent", "letter of appointment", "job offer",
    "offer of internship", "internship offer letter", "employment agreement", "appointment order", "letter of employment", "private limited",
]
CONTACT_WORDS = ["tel", "phone", "mobile", "fax", "email", "e-mail", "www", "http"]
CLAUSE_SIGNS = [
    "aforesaid", "hereby", "gone through", "terms (?:and|&) conditions", "undersigned", "shall", "will be", "will report", "herein", "whereas", "i have", "i accept",
    "required to", "reporting to", "effective from", "with effect", "background check", "discharging",
]
ROLE_SIGNS = [
    r"authoris\w*", r"authoriz\w*", "signatory", "manager", "director", "executive", "officer", "head", r"human\s+resour\w*", r"recruit\w*", "talent", "chro", "hrd",
    "partner", "founder", "proprietor", "president", "ceo", "cfo", "coo", "department", "payroll", "hr",
]
NAME_LABELS = ["designation", "department", "position", "role", "title", "date", "email", "e-mail", "mobile", "phone", r"employee\s+id", r"emp\s+id", "ctc", "salary"]
NOT_NAMES = [
    "offer", "letter", "appointment", "annexure", "from", "to", "date", "subject", "ref", "dear", "sincerely", "faithfully", "regards", "thanks", "employee",
    "candidate", "name", "designation", "company", "signature", "associate", "analyst", "trainee", "intern", "engineer", "consultant", "specialist", "processing",
    "operations", "assistant", "coordinator",
]
NAME_SUFFIXES = ["pvt", "ltd", "limited", "llp", "inc", "corp", "technologies", "solutions", "services", "enterprises", "industries"]
ROLE_SUFFIXES = ["pvt", "ltd", "limited", "llp", "inc"]
NOT_TITLES = [
    "result", "breach", "breaches", "any", "all", "such", "other", "above", "below", "therefore", "whereas", "herein", "thereof", "indemnity", "liability",
    "obligation", "pursuant", "agreement", "clause", "section", "provision", "shall", "will", "may", "must", "upon", "under", "you", "this", "employs", "contract",
    "compensation", "graduation", "post-graduation", "postgraduation", "graduate", "graduates", "diploma", "intermediate", "matriculation", "schooling",
    "certificates", "testimonials", "memos", "degree",
]
JOINING_WORDS = ["of", "by", "and", "or", "any", "all"]
PLACEHOLDERS = [("repeated R", "(?i)R{5,}"), ("underscores", "_{4,}"), ("brackets", r"\[[A-Z][A-Z\s]{2,}\]"), ("dashes", "-{5,}"), ("repeated X", r"(?i)\bX{4,}\b"), ("braces", r"\{\{[^}]*\}\}"), ("angles", r"<[A-Z][A-Z\s]{2,}>")]
DESIGN_TOOLS = ["Canva", "Photoshop", "GIMP", "Illustrator", "CorelDraw", "Paint.NET", "Inkscape", "Affinity"]
EDITING_SUITES = ["Foxit PhantomPDF", "Foxit PDF Editor", "WPS Office", "WPS PDF"]
ONLINE_TOOLS = ["iLovePDF", "Smallpdf", "PDF24", "PDFescape", "PDFsam", "Sejda"]
# Fixed values of the field audit: words that a name, a title or a designation should not hold.
CLAUSE_WORDS = [
    "aforesaid", "hereby", "gone through", "terms and conditions", "accept", "undersigned", "shall", "will be", "herein", "whereas", "agree", "the company",
    "i have", "reporting", "effective",
]
ROLE_WORDS = [
    "authorized", "authorised", "signatory", "manager", "executive", "officer", "director", "head", "department", "human resources", "hr", "recruiter",
    "partner", "associate",
]
HEADING_WORDS = ["offer", "appointment", "letter", "annexure", "designation", "position", "salary", "ctc"]
SCHOOL_WORDS = [
    "graduation", "post-graduation", "postgraduation", "graduate", "graduates", "diploma", "intermediate", "matriculation", "degree", "certificates",
    "testimonials", "memos", "schooling",
]
LABEL_WORDS = ["offer", "letter", "from", "to", "date", "subject", "ref", "dear", "annexure", "company", "name"]
METROS = ["Bangalore", "Mumbai", "Delhi", "Hyderabad", "Chennai", "Pune"]
PILLARS = {"image": 11, "text": 11, "signature": 11, "date": 11, "salary": 11, "grammar": 12, "hr": 11, "company": 11, "online": 11}
# What a scorer's answer calls the pillars (each with _score and _reasoning), and what reports call them, in their order.
ANSWER_KEYS = {
    "image": "image_tampering", "signature": "signature_tampering", "text": "text_tampering", "date": "date_tampering", "salary": "salary_details", "grammar": "grammar_errors",
    "hr": "hr_signature_details", "company": "company_details",
}
REPORT_PILLARS = {
    "online": "Company Online Presence", "company": "Company Details", "hr": "HR Signature & Details", "grammar": "Grammar & Employment Terms", "salary": "Salary Details",
    "date": "Date Tampering", "signature": "Signature Tampering", "text": "Text Tampering", "image": "Image Tampering",
}
MOST_FLAGS = 15
# Words that mark a page of a letter, and words that a company's guessed domain leaves out.
SALARY_PAGE = [
    "basic", "hra", "ctc", "gross salary", "net salary", "net pay", "total compensation", "salary breakup", "annexure", "allowance", "deductions", "provident fund",
    "gratuity", "cost to company", "total fixed pay", "tfp", "stipend",
]
SIGNATURE_PAGE = [
    "authorized signatory", "authorised signatory", "yours sincerely", "yours faithfully", "with regards", "warm regards", "best regards", "hr manager", "human resources",
    "signing authority", "for and on behalf", "acceptance", "employee signature",
]
NOT_IN_DOMAINS = [
    "pvt", "ltd", "private", "limited", "solutions", "software", "technologies", "tech", "services", "india", "llp", "inc", "global", "foundation", "trust", "corp",
    "company", "co",
]
INFORMATIONAL = ["Rendered ", "Signature close-up rendered", "Composite-forgery scan:", "Tamper scan:"]


# What each sign costs, and the limits of the rules.
@dataclass(frozen=True)
class Penalties:
    red_phrase: int = 10
    red_phrase_cap: int = 30
    impossible_date: int = 15
    salary_math: int = 12
    metadata: int = 8
    online_edit: int = 2
    completeness: int = 10
    template: int = 15
    future_offer: int = 15
    very_old: int = 20
    stale: int = 10


@dataclass(frozen=True)
class Settings:
    """as_of takes the place of the wall clock in every rule that compares with today; it is the day of the start if none is given."""

    as_of: str = field(default_factory=lambda: dt.date.today().isoformat())
    first_year: int = 2018
    legitimate: int = 80
    review: int = 51
    max_gap: int = 90
    short_gap: int = 3
    complete: float = 0.6
    max_bytes: int = 50 * 1024 * 1024
    penalties: Penalties = field(default_factory=Penalties)


DEFAULT = Settings()
