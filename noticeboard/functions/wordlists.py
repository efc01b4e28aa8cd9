"""Word lists that rules compare against. They state observable behaviour as text."""

# Fixed values of the post classifier.
BAD_EXACT_TITLES = (
    "home", "homepage", "about", "about us", "contact", "contact us",
    "feedback", "help", "faq", "login", "logout", "register", "registration",
    "new registration", "forgot password", "reset password", "view all", "view more",
    "read more", "more", "menu", "search", "sitemap", "vacancy", "vacancies",
    "vacancy position", "vacancy/nia", "recruitment", "recruitments",
    "view all recruitment", "recruitment advertisement", "advertisement",
    "notification", "notifications", "apply online", "online application",
    "results", "result", "old result", "old results", "latest result",
    "answer key", "answer keys", "syllabus", "admit card", "hall ticket",
    "examination", "exam", "today's exam", "todays exam", "support", "student",
    "academic courses", "terms of service", "privacy policy", "cookie policy",
    "website policies", "copyright", "accessibility", "gallery", "photo gallery",
    "government orders", "orders and notification", "circular", "circulars",
    "organization", "organisation", "organization structure", "rti", "rti manuals",
    "financial results", "quarterly financial results", "press releases",
    "search in notices and notifications", "click here", "apply links",
    "section a indicative syllabus", "section-b indicative syllabus",
)
BAD_PHRASES = (
    "view all", "view more", "read more", "click here", "click on this link",
    "modify online details", "after submission", "download notification",
    "download guidelines", "download form", "login / register", "login register",
    "forgot password", "reset password", "terms of service", "privacy policy",
    "academic courses", "support_agent", "skip to main content", "select your language",
    "unserved notices", "financial results", "quarterly financial", "blacklisted firms",
    "copyright", "all rights reserved", "sitemap", "web information manager",
    "vacancy through", "vacancy advertised", "tribunal vacancy", "post new job",
    "question bank", "press release", "press-release", "admission", "admissions",
    "course", "courses", "student", "students", "fee payment", "payment of examination fee",
)
BAD_DOMAINS = (
    "economictimes.indiatimes.com", "amarujala.com", "ndtv.in", "ndtv.com",
    "timesnowhindi.com", "jagran.com", "hindustantimes.com", "news18.com",
    "aajtak.in", "zeenews.india.com", "indiatoday.in", "firstpost.com",
    "thequint.com", "newsbytesapp.com", "freepressjournal.in",
)
BAD_URL_PARTS = (
    "/login", "/logout", "/register", "/registration", "/forgot", "/reset", "/search",
    "/about", "/contact", "/feedback", "/gallery", "/photo-gallery", "/privacy", "/cookie",
    "/sitemap", "/website-policies", "/organization", "/organisation", "/chairman", "/member",
    "/finance-controller", "/examination-controller", "/public-information-officer",
    "/appellate-authority", "/web-information-manager", "/act-and-rule", "/rti", "/manual",
    "/student", "/academic", "/event", "/archive", "/old-recruitment", "/old-result",
    "/resultold", "/financial-results", "/financial-result", "/press-release", "/press-releases",
)
GOOD_URL_PARTS = (
    "/recruitment", "/notification", "/advertisement", "/vacancy", "/career", "/careers",
    "/job", "/jobs", "/advt", "/engagement", "/apprentice", "/apprenticeship", "/result",
    "/admit-card", "/admit_card", "/answer-key", "/answer_key", "/syllabus", "/selection",
    "/exam", "/examination", "/hall-ticket", "/hall_ticket", "/merit", "/counselling",
)
RECRUITMENT_TERMS = (
    "recruitment", "recruitments", "vacancy", "vacancies", "advertisement", "advt",
    "direct recruitment", "engagement", "hiring", "appointment", "walk-in", "walk in",
    "apprentice", "apprenticeship", "application invited", "applications are invited",
    "apply online", "online application", "career", "careers", "job", "jobs",
    "भर्ती", "विज्ञापन", "विज्ञप्ति", "रिक्ति", "रिक्तियां", "आवेदन आमंत्रित",
    "ऑनलाइन आवेदन", "नियुक्ति", "अप्रेंटिस", "साक्षात्कार", "सीधी भर्ती", "पद हेतु आवेदन",
)
RESULT_TERMS = (
    "result", "results", "merit list", "score card", "scorecard", "individual score", "final scorecard",
    "recommendation", "selected candidate", "selected candidates", "selection list",
    "list of qualified candidates", "marks obtained", "परिणाम", "मेरिट", "संस्तुति",
)
ADMIT_TERMS = ("admit card", "e-admit card", "admit-card", "hall ticket", "hall-ticket", "call letter", "call letters", "call-letter", "प्रवेश पत्र")
ANSWER_TERMS = ("answer key", "answer keys", "उत्तर कुंजी", "उत्तरकुंजी")
SYLLABUS_TERMS = ("syllabus", "indicative syllabus", "पाठ्यक्रम")
SCHOLARSHIP_TERMS = ("scholarship", "छात्रवृत्ति")
EXAM_TERMS = ("exam schedule", "exam programme", "exam program", "exam calendar", "time table", "timetable", "date sheet", "परीक्षा कार्यक्रम", "परीक्षा समय सारणी")
ROLE_TERMS = (
    "assistant", "teacher", "officer", "engineer", "technician", "constable", "inspector", "clerk",
    "stenographer", "patwari", "lekhpal", "fellow", "research", "professional", "scientist", "staff",
    "faculty", "professor", "lecturer", "driver", "junior", "senior", "manager", "analyst", "surgeon",
    "doctor", "nurse", "pharmacist", "attendant", "peon", "counsellor", "chairperson", "member",
    "शिक्षक", "अधिकारी", "प्रोफेसर", "व्याख्याता", "अनुसंधान", "पद", "कर्मचारी", "निदेशक",
)
SPECIFIC_PHRASES = (
    "applications are invited", "application invited", "for the post", "for the posts", "recruitment of",
    "advertisement for", "advertisement no", "online application for", "selection of",
)
SPECIFIC_RESULT_PHRASES = (
    "result of", "results of", "re-examination results", "selected candidate", "selection list",
    "scorecard", "score card", "marks obtained", "merit list",
)
NOT_A_RESULT = ("resulted in order", "resulting in", "financial result", "quarterly financial", "nano fertiliser", "trial results")
CONCRETE_PHRASES = (
    "recruitment of", "advertisement for", "for the post", "for the posts", "applications are invited",
    "application are invited", "application invited", "online applications are invited", "walk-in interview",
    "walk in interview", "engagement of", "appointment of", "selection of",
)
NOT_A_JOB = (
    "recruitment rules", "recruitment calendar", "recruitment cell", "recruitment archive",
    "appointment of", "re-appointment", "reappointment", "re-appointed",
    "extension of last date", "extension of date", "date extended",
    "refund of fee", "refund of fees", "stands cancelled", "cancelled",
    "cancellation of", "selection list", "preference selection", "re-examination",
    "result of", "results of", "marks of the candidates", "qualified candidates",
    "selected candidates", "shortlisted candidates", "press release", "press-release",
    "notification of api score", "api score", "recruitment results", "recruitment notices",
    "recruitment/admission", "online application link", "application link", "national ict awards",
    "award", "student", "students", "course", "fee", "fees", "score", "marks", "mock test",
    "question bank", "question paper", "previous year", "rules of", "terms and conditions",
)
RESCUE_PHRASES = ("applications are invited", "recruitment of", "advertisement for", "for the post")

# Fixed values of the title-first post type.
TYPE_ADMIT = ("admit card", "admit-card", "hall ticket", "e-admit", "call letter", "call-letter", "प्रवेश पत्र", "प्रवेश-पत्र")
TYPE_ANSWER = ("answer key", "answer-key", "answerkey", "उत्तर कुंजी", "उत्तरकुंजी")
TYPE_SYLLABUS = ("syllabus", "exam pattern", "पाठ्यक्रम")
TYPE_SCHOLARSHIP = ("scholarship", "fellowship", "छात्रवृत्ति")
TYPE_RECRUITMENT = (
    "recruitment", "vacancy", "advertisement", "advt", "direct recruitment", "apply online",
    "online application", "registration from", "applications are invited", "engagement", "hiring",
    "भर्ती", "विज्ञापन", "विज्ञप्ति", "अधिसूचना", "रिक्ति", "ऑनलाइन आवेदन",
)

# Fixed values of the department rules, in order of trial.
SOURCE_DEPARTMENTS = {
    "ssc": "SSC", "upsc": "UPSC", "ibps": "IBPS", "ukpsc": "UKPSC", "uksssc": "UKSSSC", "railway": "Railway", "psc": "PSC",
    "rpsc": "RPSC", "uppsc": "UPPSC", "bpsc": "BPSC", "mppsc": "MPPSC", "cgpsc": "CGPSC", "jpsc": "JPSC",
}
ORGANISATION_RULES = {
    "AIIMS": ("aiims", "all india institute of medical sciences"), "ICAR": ("icar",), "IIT": ("iit",), "IIM": ("iim",), "NIT": ("nit",),
    "UPSC": ("upsc",), "SSC": ("ssc",), "IBPS": ("ibps",), "UKPSC": ("ukpsc",), "UKSSSC": ("uksssc",),
}
DEPARTMENT_RULES = {
    "Banking": ("bank", "ibps", "rbi", "nabard", "lic", "sbi", "sidbi", "banking"),
    "Railway": ("railway", "rrb", "rrc", "rail"),
    "Defence": ("army", "navy", "air force", "drdo", "bsf", "crpf", "cisf", "itbp", "defence"),
    "Teaching": ("teacher", "faculty", "lecturer", "professor", "school teacher", "education department"),
    "Medical": ("medical", "doctor", "nurse", "pharmacist", "aiims", "hospital", "health"),
    "Police": ("police", "constable", "inspector", "cop"),
    "Agriculture": ("agriculture", "agricultural", "krishi", "horticulture", "forestry", "icar", "kvk"),
}
GENERIC_DEPARTMENTS = ("government", "latest jobs", "latest updates", "none", "null", "not mentioned")

# Fixed values of the merge: what counts as no value, and what counts as a change.
PLACEHOLDERS = (
    "", "not mentioned", "check official notification", "check notification", "as per rules", "not available",
    "उपलब्ध नहीं", "आधिकारिक अधिसूचना देखें", "official notification", "n/a", "na", "none", "null", ".",
)
IDENTITY_FIELDS = ("title", "url", "category", "post_type", "department", "year", "tags", "keywords", "is_valid_post")
DETAIL_FIELDS = (
    "vacancy", "qualification", "salary", "age_limit", "application_fee", "selection_process", "exam_date",
    "application_start_date", "last_date", "description", "content", "apply_link", "notification_pdf",
    "official_website", "official_notification_pdf", "notification_date", "notification_text",
)

# Fixed values of link scoring.
LINK_KEYWORDS = ("recruitment", "vacancy", "notification", "apply", "job", "result", "admit", "answer key", "exam")
APPLY_TEXTS = ("apply online", "apply now", "online application", "registration", "fill online", "आवेदन करें", "ऑनलाइन आवेदन")
NOT_ADVERTISEMENT = (
    "information handout", "call letter", "admit card", "hall ticket", "result", "joining schedule", "scorecard",
    "scribe", "guidelines", "question paper", "answer key", "syllabus",
)
ADVERTISEMENT = (
    "detailed advertisement", "recruitment advertisement", "advertisement", "recruitment notification",
    "notification", "advt", "vacancy", "विज्ञापन", "अधिसूचना",
)
PDF_STRONG = ("detailed advertisement", "recruitment notification", "advertisement.pdf", "advt.")
PDF_WEAK = ("information handout", "call letter", "result", "joining schedule", "scorecard", "guidelines")

# Fixed values of search: spelling and synonyms.
SPELLING = {
    "ctett": "ctet", "utett": "utet", "upse": "upsc", "upssc": "upsc", "ibsp": "ibps", "railwey": "railway",
    "railwai": "railway", "bank": "banking", "teacherjob": "teacher", "govt": "government", "gov": "government",
    "admitcard": "admit card", "answerkey": "answer key", "scholarships": "scholarship", "results": "result",
}
SYNONYMS = {
    "teacher": ("tet", "ctet", "utet", "lecturer", "assistant professor", "principal"),
    "banking": ("bank", "ibps", "sbi", "pnb", "bob"),
    "railway": ("rrb", "rail", "ntpc", "alp", "technician"),
    "defence": ("army", "air force", "navy", "agniveer", "bsf", "crpf"),
    "upsc": ("ias", "ifs", "ips", "civil services"),
    "ssc": ("cgl", "chsl", "gd", "mts"),
}

# Fixed values of the publication gate.
GATE_BLOCKED = (
    "public notice", "physical screening test", "written examination", "written test", "time table", "schedule of",
    "selection list", "selected candidates", "qualified candidates", "shortlisted candidates", "answer key", "answer-key",
    "admit card", "admit-card", "hall ticket", "call letter", "result of", "merit list", "waiting list", "score card",
    "scorecard", "exam schedule", "examination schedule", "exam date", "interview schedule", "corrigendum",
    "extension of last date", "date extended", "last date extended", "press release", "press-release", "appointment of",
    "re-appointed", "reappointed", "vice chancellor", "vice-chancellor", "second term", "deputation",
    "चयन सूची", "चयनित उम्मीदवार", "उत्तर कुंजी", "प्रवेश पत्र", "परिणाम", "तिथि बढ़ी", "अंतिम तिथि बढ़ी", "समयपरिवर्तन",
    "समय परिवर्तन", "लिखित परीक्षा", "शारीरिक दक्षता परीक्षा", "कुलपति", "पुनः नियुक्त", "शुल्क वापसी",
)
GATE_RECRUITMENT = (
    "recruitment", "vacancy", "vacancies", "applications are invited", "application invited", "apply online",
    "online application", "engagement of", "walk-in", "walk in", "apprentice", "apprenticeship", "भर्ती", "रिक्ति",
    "आवेदन आमंत्रित", "ऑनलाइन आवेदन", "सीधी भर्ती",
)
GATE_PLACEHOLDERS = (
    "", "not mentioned", "not available", "not specified", "check official notification", "check notification", "as per rules",
    "उपलब्ध नहीं", "आधिकारिक अधिसूचना देखें", "n/a", "na", "none", "null", "-", "--",
)
SALARY_NOT = ("application fee", "exam fee", "processing fee", "page no", "page number")
SALARY_TERMS = (
    "pay level", "pay scale", "basic pay", "salary", "remuneration", "consolidated pay", "per month", "per annum",
    "stipend", "emolument", "pay matrix", "level-",
)

# Fixed values of homepage noise and of candidate ranking.
NOISE_TITLES = ("view all results", "view all recruitment", "view results")
NOISE_PATTERN = r"^(view\s*all|view\s*more|more\.{0,3}|support|academic\s+courses?|student|key\s+dates?|vacancy\s*/\s*nia|varieties)$"
RANK_PHRASES = (
    "applications are invited", "apply online", "online application", "registration from", "recruitment of",
    "recruitment –", "recruitment -", "भर्ती", "आवेदन आमंत्रित",
)

# Fixed values of the homepage category.
HOME_UK = ("uttarakhand", "उत्तराखंड", "uksssc", "ukpsc", "ukmssb", "psc.uk.gov.in", "sssc.uk.gov.in", "uttarakhand police", "uttarakhand forest")
HOME_RAILWAY = ("railway", "rrb", "rrc", "metro rail")
HOME_BANKING = ("ibps", "sbi", "rbi", "pnb", "bank of baroda", "canara bank", "banking")
HOME_EXPLICIT = (
    "result", "results", "admit card", "answer key", "answer keys", "scholarship", "syllabus", "teaching exams", "entrance exams",
    "government schemes", "banking jobs", "banking", "railway jobs", "railway", "uttarakhand jobs", "central jobs",
    "central government jobs", "other state jobs", "recruitment",
)

# Fixed values of the generic scan's categories.
GENERIC_ADMIT = ("admit card", "hall ticket", "call letter", "e-admit card")
GENERIC_RESULT = ("result", "results", "merit list", "selection list", "score card", "final result", "provisional result")
GENERIC_ANSWER = ("answer key", "provisional answer key", "final answer key", "response sheet")
GENERIC_SYLLABUS = ("syllabus", "exam pattern", "scheme of examination")
GENERIC_SCHOLARSHIP = ("scholarship", "fellowship", "stipend")
GENERIC_SCHEME = ("scheme", "yojana", "yojna")

# Fixed values of the editor's types and gate.
EDITOR_ADMIT = ("admit card", "admit-card", "hall ticket", "call letter", "e-admit", "प्रवेश पत्र")
EDITOR_ENTRANCE = ("entrance exam", "entrance test", "admission test", "प्रवेश परीक्षा")
EDITOR_INTERVIEW = ("walk-in interview", "walk in interview", "interview schedule", "interview", "साक्षात्कार")
EDITOR_NOTICE = (
    "examination schedule", "exam schedule", "exam date", "examination date", "schedule updated", "important notice", "notice regarding",
    "regarding the examination", "परीक्षा के आयोजन", "परीक्षा तिथि", "महत्वपूर्ण सूचना", "सूचना",
)
EDITOR_APPLY = ("applications are invited", "application invited", "apply online", "online application", "आवेदन आमंत्रित", "ऑनलाइन आवेदन")
EDITOR_RECRUITMENT = (
    "recruitment", "vacancy", "vacancies", "applications are invited", "application invited", "apply online", "engagement of", "appointment of",
    "भर्ती", "रिक्ति", "आवेदन आमंत्रित",
)
EDITED_BLOCKED = (
    "admit card", "admit-card", "hall ticket", "call letter", "answer key", "answer-key", "result", "results", "merit list", "selected candidates",
    "selected candidate", "qualified candidates", "shortlisted candidates", "waiting list", "previous year", "question paper", "exam schedule",
    "examination schedule", "corrigendum", "date extension", "extension of last date", "extension of date", "re-schedule", "reschedule",
    "individual score", "vice chancellor", "vice-chancellor", "second term", "re-appointed", "reappointed", "कुलपति", "पुनः नियुक्त", "कार्यकाल",
    "प्रवेश पत्र", "कॉल लेटर", "चयनित उम्मीदवार", "प्रतीक्षा सूची", "उत्तर कुंजी", "परिणाम", "संशोधित तिथि",
)

# Fixed values of category pages.
CATEGORY_NOISE = (
    "view all", "view all results", "view all recruitment", "results", "recruitment", "notification", "advertisement", "apply online",
    "new registration", "step-1: new registration", "step-1", "recruitment/admission links", "examination", "event key dates",
)
ERROR_PAGES = (
    "page you’ve requested either does not exist", "page you've requested either does not exist", "go back home previous button",
    "app store google play facebook", "the page you requested either does not exist",
)
CHROME = ("forgot password", "login/register", "login register", "skip to main content")
NOT_LATEST = ("admit card", "hall ticket", "call letter", "answer key", "result", "syllabus", "scholarship")

# Fixed values of records: search endings of a title, and the columns of dates in order of trial.
KEYWORD_ENDINGS = ("Recruitment", "Notification", "Apply Online", "Vacancy", "Jobs", "Last Date", "Official Notification")
SOURCE_DATES = ("notification_date", "source_date", "published_date", "date_published", "posted_date")
PUBLICATION_DATES = ("publish_date", "published_date", "date_published", "posted_date", "notification_date", "date")
CLOSED_PATTERN = (
    r"(?i)\b(?:application|applications|registration)\s+(?:is\s+|are\s+)?(?:closed|over)\b|\b(?:application|registration)\s+closed\b"
    r"|\bexpired\b|(?<![\p{L}\p{N}_])आवेदन\s*(?:बंद|समाप्त)(?![\p{L}\p{N}_])"
)
PAGE_NOISE = (
    "apply online", "apply now", "recruitment", "recruitments", "recruitment notices", "application forms", "application form",
    "apply links", "recruitment/admission links", "results", "answer keys", "question bank online exam", "forget password", "login", "home",
    "vacancy", "vacancies", "vacancy/nia", "vacancy position", "download interview letter", "download hindi notification",
    "download guidelines for candidates for filling up online application",
)
INDEX_NOISE = ("", "support", "student", "results", "more", "more...", "support_agent support", "event student", "event key dates")

# Fields that a merge compares.
COMPARED_FIELDS = (
    "title", "url", "category", "department", "vacancy", "qualification", "salary", "age_limit", "application_fee", "selection_process",
    "exam_date", "application_start_date", "last_date", "description", "apply_link", "notification_pdf", "official_website",
    "notification_date", "notification_text",
)

# Fixed values of the candidate test.
CANDIDATE_BLOCKED = (
    "result", "results", "answer key", "answer-key", "admit card", "admit-card", "hall ticket", "score card", "scorecard",
    "merit list", "selected candidates", "selected candidate", "qualified candidates", "qualified candidate",
    "previous year", "previous years", "question paper", "question papers", "exam schedule", "examination schedule",
    "exam date", "examination date", "interview schedule", "corrigendum", "extension of last date", "extension of date",
    "revised schedule", "date extended", "provisional answer", "syllabus", "shortlisted candidates", "shortlisted candidate",
    "final answer key", "waiting list", "cut off", "cut-off", "score list", "individual score", "call letter",
    "main examination call letter", "preliminary examination call letter", "provisionally selected", "provisionally shortlisted",
    "no candidate shortlisted", "list of candidates", "candidate shortlisted", "selected in second wait list", "second wait list",
    "backlog vacancies (preliminary examination", "vice chancellor", "vice-chancellor", "kulapati", "re-appointed", "reappointed",
    "second term", "कार्यकाल", "कुलपति", "पुनः नियुक्त", "नियुक्त किया गया", "appointment announced",
    "press release", "press-release", "gazette", "act,", "act ", "rti officer", "rti officers", "faq", "notice to the candidates",
    "marks of the candidates", "eligible and ineligible candidates", "refund of fee", "refund of fees", "stands cancelled",
    "cancellation of", "preference selection",
)
APPOINTMENT_NEWS = (
    "appointment of", "re-appointed", "reappointed", "vice chancellor", "vice-chancellor", "second term", "कुलपति", "पुनः नियुक्त", "नियुक्त किया गया",
)
APPOINTMENT_OPEN = ("recruitment", "vacancy", "apply online", "applications are invited", "application invited", "भर्ती", "रिक्ति", "आवेदन आमंत्रित")
CANDIDATE_TERMS = (
    "recruitment", "vacancy", "vacancies", "applications are invited", "application invited", "apply online", "online application",
    "engagement of", "appointment of", "walk-in", "walk in", "भर्ती", "रिक्ति", "आवेदन आमंत्रित", "ऑनलाइन आवेदन", "नियुक्ति", "संविदा",
    "guest lecturer", "contractual",
)

# Fixed values of detail fields.
DETAIL_PLACEHOLDERS = (
    "", "not mentioned", "not available", "check official notification", "check notification", "official notification", "as per rules",
    "see official notification", "available", "none", "null", "n/a", "na", "उपलब्ध नहीं", "आधिकारिक अधिसूचना देखें", "आधिकारिक अधिसूचना में देखें",
)
# Beginnings of values that were cut out of a sentence; words that say nothing alone.
FRAGMENT_STARTS = ("as on", "as at", "c at the time", "c. at the time", "at the time of", "at the time")
LONE_WORDS = ("a", "an", "the", "of", "and", "or", "i", "ii", "iii", "iv")
TIMELINE_WORDS = ("as on", "registration opens", "important timeline")
INSTRUCTION_WORDS = ("registration opens", "registration closes", "important timeline", "apply online now", "create an account")
FREE_WORDS = ("free", "no fee", "nofee", "nil", "निशुल्क", "निःशुल्क", "शुल्क नहीं", "शुल्कनहीं")
LINK_MARKS, SOCIAL_SITES = ("http://", "https://", "www."), ("facebook", "twitter", "instagram")
DETAIL_CURRENCIES = ("₹", "rs", "inr")
MONTH_STARTS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
SENT_ELSEWHERE = ("check official notification", "आधिकारिक अधिसूचना देखें")
SCAN_FRAGMENTS, SCAN_MARKS, USUAL_SIGNS = ("ment Done", "Jiw", "Tfs", "Tfr"), "\\^`~", r".,:;!?()/%₹+\-&–—'\"\[\]"
SELECTION_CHATTER = (
    "के संबंध में जानकारी", "परीक्षा कार्यक्रम", "प्रवेश पत्र", "आयोग की वेबसाइट", "वेबसाइट पर उपलब्ध", "information regarding",
    "exam programme", "download admit card", "visit the website", "for more information",
)
USABLE_NOT = ("not mentioned", "check official notification", "not available", "as per rules", ".", "null", "none", "available")
EDITOR_PLACEHOLDERS = (
    "", "not mentioned", "not available", "check notification", "check official notification", "as per rules", "उपलब्ध नहीं",
    "आधिकारिक अधिसूचना देखें", "n/a", "na", "none", "null", ".",
)
READER_PLACEHOLDERS = (
    "not available", "not mentioned", "not provided", "check official notification", "check notification", "as per rules", "to be announced",
    "tba", "n/a", "na", "none", "null", "unknown", "-", "--", "—", "–",
)
STRUCTURED_PLACEHOLDERS = (
    "", "not mentioned", "not available", "check official notification", "check notification", "as per rules", "n/a", "na", "none", "null", "-", "=", ".",
)
PAGE_PLACEHOLDERS = (
    "", "-", "—", "n/a", "na", "not available", "not mentioned", "official notification", "check official notification", "see official notification",
    "आधिकारिक अधिसूचना देखें", "उपलब्ध नहीं", "उपलब्ध नहीं है",
)
PLACEHOLDER_SETS = {
    "merge": PLACEHOLDERS, "gate": GATE_PLACEHOLDERS, "editor": EDITOR_PLACEHOLDERS, "reader": READER_PLACEHOLDERS,
    "detail": DETAIL_PLACEHOLDERS, "structured": STRUCTURED_PLACEHOLDERS, "page": PAGE_PLACEHOLDERS,
}

# Fixed values of reader texts: the texts that each module reads, in order, and the labels of the summary.
SOURCE_TEXTS = {
    "reader": ("notification_text", "notification_content", "content", "description", "summary", "text", "raw_text", "body", "title"),
    "structured": ("notification_text_clean", "notification_text", "notification_content", "content", "raw_text", "description", "text", "body", "title"),
    "page": ("notification_text", "content", "raw_text", "body", "text"),
}
SUMMARY_LABELS = {"vacancy": "Total vacancies", "qualification": "Educational qualification", "salary": "Salary/Pay", "last_date": "Last date"}
READER_NOISE = (
    "skip to main content", "select your language", "screen reader", "accessibility", "sitemap", "site map", "copyright", "privacy policy",
    "terms and conditions", "go to index", "table of contents", "contents", "previous page", "next page", "page |", "a- a a+", "a a a",
    "main content", "click here for", "back to top", "print this page", "share this page",
)
# Mojibake sequences and what they stand for, the longest first where one begins another; then what is only removed.
MOJIBAKE = {
    "â€“": "–", "â€”": "—", "â€¢": "•", "â€˜": "‘", "â€™": "’", "â€œ": "“", "â€\u009d": "”", "â€": "”",
    "Â": "", "ï»¿": "", "�": "", "￾": "", "­": "",
}
ZERO_WIDTH = "​‌‍"
# Fixed values of Devanagari spacing: whole words, beginnings and endings that text extraction sets apart.
HINDI_WORDS = (
    "में", "के", "का", "की", "को", "से", "पर", "और", "या", "एक", "यह", "वह", "इस", "उस", "ने", "तो", "ही", "भी", "है", "हैं", "था", "थे",
    "थी", "हो", "तथा", "हेतु", "द्वारा", "लिए", "पद", "पदों", "तक", "दिए", "गए", "जाने", "वाले", "वाली", "वाला", "कर", "केवल", "सभी", "आदि", "सी",
)
HINDI_BEGINNINGS = (
    "बॉ", "टनि", "रि", "इंस्टी", "डा", "लि", "वि", "ज्ञा", "अंति", "ति", "सहा", "तृती", "कैशि", "ऑनला", "पदना", "कार्या", "शैक्षि", "योग्", "आवा",
    "अधि", "प्रा", "परि", "प्रमा", "विज्ञा", "ट्यू", "एनबी",
)
HINDI_ENDINGS = ("टनि", "कल", "सर्च", "ट्यूट", "यरेक्टर", "ए", "ज्ञा", "पन", "म", "थि", "यक", "यर", "इन", "लय", "र्या", "आरआई", "य", "ल", "ना", "न")

# Fixed values of slugs: Hindi words and their English ones, replaced longest first.
SLUG_WORDS = {
    "सरकारी": "government", "नौकरी": "job", "नौकरियां": "jobs", "भर्ती": "recruitment", "भर्तियां": "recruitments", "रिक्ति": "vacancy",
    "रिक्तियां": "vacancies", "अधिसूचना": "notification", "प्रवेश": "admit", "पत्र": "card", "परिणाम": "result", "उत्तर": "answer", "कुंजी": "key",
    "छात्रवृत्ति": "scholarship", "परीक्षा": "exam", "पाठ्यक्रम": "syllabus", "शिक्षक": "teacher", "पुलिस": "police", "वन": "forest", "विभाग": "department",
    "केंद्र": "central", "राज्य": "state", "उत्तराखंड": "uttarakhand", "ऑनलाइन": "online", "आवेदन": "application", "अंतिम": "last", "तिथि": "date",
    "योजना": "scheme", "विज्ञापन": "advertisement", "अभ्यर्थी": "candidate",
}

# Fixed values of card links and the official lookup.
CARD_STOPWORDS = (
    "recruitment", "notification", "advertisement", "advt", "online", "application", "apply", "post", "posts", "vacancy", "vacancies",
    "2024", "2025", "2026", "2027", "dated", "for", "the", "of", "and", "to", "in", "on", "at", "with", "engagement", "regarding", "through",
    "click", "here", "link", "details", "detailed", "notice", "latest",
)
CARD_ADVERTISEMENT = (
    "detailed advertisement", "detailed notification", "recruitment notification", "advertisement", "notification", "advt", "विज्ञापन", "अधिसूचना", "डाउनलोड",
)
CARD_DOCUMENT = ("view", "download", "document", "notice", "pdf", "loadpdf")
CARD_OTHER = ("result", "answer key", "admit card", "hall ticket", "call letter", "joining", "scorecard", "syllabus", "guidelines", "question paper")
CARD_CHROME = ("contact", "privacy", "login", "register", "feedback", "home")
CARD_PATHS = (
    "/recruitment", "/recruitments", "/careers", "/career", "/notification", "/advertisement", "/vacancy", "/advt", "/notice", "/document",
    "/job", "/jobs", "viewpdf", "open_pdf", "loadpdf",
)
CARD_STRONG = ("download advertisement", "detailed advertisement", "recruitment notification", "advertisement pdf", "notification pdf")
CARD_APPLY = ("apply online", "apply now", "registration")
CARD_WRONG = ("result", "answer key", "admit card", "hall ticket", "call letter", "syllabus", "information handout")
OFFICIAL_STOPWORDS = (
    "recruitment", "registration", "from", "post", "the", "and", "of", "for", "in", "direct", "officer", "officers", "2026", "2025", "2027",
    "dated", "online", "application",
)
OFFICIAL_ROLES = {
    "agm": ("agm", "assistant general manager"), "local bank officer": ("local bank officer", "lbo"), "law officer": ("law officer",),
    "site engineer": ("site engineer",), "specialist officer": ("specialist officer", "so bip"),
}
OFFICIAL_STRONG = ("detailed advertisement", "recruitment advertisement", "advertisement.pdf", "recruitment notification")
OFFICIAL_WEAK = ("information handout", "call letter", "result", "joining schedule", "scorecard", "scribe", "guidelines")
OFFICIAL_PATHS = ("advertisement", "recruitment", "notification", "advt")

# Fixed values of the generic scan: whole titles and words that no notice has.
GENERIC_EXACT = (
    "view all", "view more", "more", "results", "view results", "support", "student", "event", "academic", "contact", "about", "login", "home",
    "read more", "click here",
)
GENERIC_BAD_WORDS = ("view", "support", "student", "academic", "event", "more")

# Action links of a page by kind, and the titles that tell the type of a rendered page.
ACTION_LINKS = {
    "admit_card_url": ("download admit card", "admit card", "hall ticket", "प्रवेश पत्र", "प्रवेश-पत्र"),
    "result_url": ("view result", "check result", "result", "परिणाम", "रिजल्ट"),
    "answer_key_url": ("answer key", "answer-key", "उत्तर कुंजी", "उत्तर-कुंजी"),
    "syllabus_url": ("syllabus", "exam pattern", "पाठ्यक्रम", "परीक्षा पाठ्यक्रम"),
}
PAGE_NOTICE = ("notice", "notification", "circular", "सूचना", "अधिसूचना", "परिपत्र", "परीक्षा आयोजन")
PAGE_HIRING = ("recruitment", "vacancy", "भर्ती", "रिक्ति", "apply online", "आवेदन आमंत्रित")
SECTION_CAPS = {
    "AUTO_LATEST_GRID": 24, "AUTO_LATEST_POSTS": 12, "AUTO_UK_JOBS": 15, "AUTO_CENTRAL_JOBS": 15, "AUTO_STATE_JOBS": 15,
    "AUTO_MARQUEE": 10, "AUTO_BREAKING": 10,
}
# Fixed values of the older homepage: how many notices it takes, its sections' caps, and what a category says of central jobs.
LEGACY_MOST = 30
LEGACY_CAPS = {"latest_cards": 10, "latest_posts": 30, "uk_jobs": 10, "central_jobs": 10, "state_jobs": 10}
LEGACY_CENTRAL = ("central", "upsc", "ssc", "railway", "bank")
# Fixed values of readers' titles and lines: calls to click at a title's end, words before a deadline in brackets, what a line of navigation says.
CLICK_WORDS, CLICK_OBJECTS, CLICK_VERBS = ("क्लिक", "click"), ("करें", "कर", "here", "to"), ("करें", "view", "apply", "download", "open")
HERE_VERBS = ("apply", "view", "download", "read", "open")
NOUNS_BEFORE_FOR = ("पाठ्यक्रम", "आवेदन", "ऑनलाइन", "विज्ञापन", "अधिसूचना", "सूचना", "परिणाम", "प्रवेश पत्र")
SQUARE_DEADLINES, ROUND_DEADLINES = ("last date", "lastdate", "अंतिम तिथि", "अंतिम तारीख"), ("last date", "lastdate", "अंतिम तिथि")
OPENING_WORDS, OPENING_LINKS = ("registration", "application"), ("from", "started from")
PAGE_WORDS, PAGE_OF = ("page", "पृष्ठ"), ("of", "/", "में से")
NAVIGATION_LINES = ("login", "register", "sign in", "home", "contact", "about", "privacy policy", "sitemap", "site map")
INDEX_MARKS = ("go to index", "contents", "index")
BULLETS, DECORATION = "•●▪◦‣►▸➤◆◇■□", "~`^_=+|<>#@%"
