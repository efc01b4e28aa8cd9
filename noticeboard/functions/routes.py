"""Signals and pages of the multi-label category routing, in order of trial."""

# Content pages.
CONTENT = {
    "banking": ("bank", "banking", "ibps", "sbi", "rbi", "pnb", "canara", "boi", "union bank", "bank of baroda"),
    "railway": ("railway", "rrb", "rrc", "metro rail"),
    "upsc": ("upsc", "union public service commission", "upsc.gov.in"),
    "ssc": ("ssc", "cgl", "chsl", "mts", "gd", "stenographer", "selection post"),
    "admit-card": ("admit card", "hall ticket", "call letter"),
    "answer-key": ("answer key", "provisional answer key", "final answer key"),
    "result": ("result", "merit list", "score card", "scorecard"),
    "scholarship": ("scholarship", "nsp", "fellowship", "financial assistance"),
    "syllabus": ("syllabus", "exam pattern"),
    "teaching-exams": ("ctet", "utet", "tet", "teacher eligibility"),
    "entrance-exams": ("neet", "jee", "cuet", "gate", "cat"),
    "government-schemes": ("scheme", "yojana", "government scheme"),
}
FALLBACK = {
    "ctet": ("ctet",),
    "utet": ("utet", "uktet"),
    "deled": ("d.el.ed", "deled", "btc"),
    "forest": ("forest department", "forest guard", "forester", "forest ranger", "forest service", "वन विभाग", "वन रक्षक"),
    "police": ("police recruitment", "police constable", "sub inspector", "head constable", "police vacancy"),
    "latest-jobs": ("recruitment", "vacancy", "notification", "apply online", "job"),
}
FALLBACK_ORDER = (
    "admit-card", "answer-key", "result", "scholarship", "syllabus", "ctet", "utet", "deled", "teaching-exams",
    "entrance-exams", "banking", "railway", "upsc", "ssc", "forest", "police", "latest-jobs",
)
TYPED = ("admit-card", "answer-key", "result", "syllabus", "scholarship")
CONTENT_PAGES = (
    "latest-jobs", "result", "admit-card", "answer-key", "scholarship", "syllabus", "teaching-exams", "entrance-exams",
    "banking", "railway", "upsc", "ssc", "ctet", "utet", "deled", "forest", "police",
)

# Locations.
DOMAIN_SIGNALS = {
    "uksssc.co.in": "uttarakhand uksssc", "sssc.uk.gov.in": "uttarakhand uksssc", "psc.uk.gov.in": "uttarakhand ukpsc",
    "highcourtofuttarakhand.gov.in": "uttarakhand high court of uttarakhand", "jpsc.gov.in": "jharkhand jpsc",
    "mppsc.mp.gov.in": "madhya pradesh mppsc", "mponline.gov.in": "madhya pradesh", "uppsc.up.nic.in": "uttar pradesh uppsc",
    "upsssc.gov.in": "uttar pradesh upsssc", "rpsc.rajasthan.gov.in": "rajasthan rpsc", "bpsc.bih.nic.in": "bihar bpsc",
}
STATE_PSC = (
    "jpsc", "jharkhand public service commission", "mppsc", "madhya pradesh public service commission",
    "uppsc", "uttar pradesh public service commission", "rpsc", "rajasthan public service commission",
    "bpsc", "bihar public service commission", "hpsc", "haryana public service commission",
    "hppsc", "himachal pradesh public service commission", "gpsc", "gujarat public service commission",
    "kpsc", "karnataka public service commission", "tnpsc", "tamil nadu public service commission",
    "tspsc", "telangana state public service commission", "opsc", "odisha public service commission",
    "ppsc", "punjab public service commission", "wbpsc", "west bengal public service commission",
    "ukpsc", "uttarakhand public service commission",
)
UK = (
    "uttarakhand", "उत्तराखंड", "उत्तराखण्ड", "ukpsc", "uksssc", "ukmssb", "ukssscrecruitment.in", "ubse", "uktet", "uk.gov.in",
    "psc.uk.gov.in", "sssc.uk.gov.in", "high court of uttarakhand", "uttarakhand high court", "uttarakhand police", "uttarakhand forest",
)
CENTRAL = (
    "central government", "government of india", "union government", "ministry of", "upsc", "ssc", "ibps", "sbi", "rbi",
    "railway", "rrb", "rrc", "lic", "nicl", "defence", "indian army", "indian navy", "air force", "psu",
)
UK_PAGES = {
    "ukpsc": ("ukpsc", "uttarakhand public service commission", "psc.uk.gov.in"),
    "uksssc": ("uksssc", "ukssscrecruitment.in", "uttarakhand subordinate service selection commission", "sssc.uk.gov.in"),
    "high-court": ("uttarakhand high court", "high court of uttarakhand", "highcourtuttarakhand", "highcourtofuttarakhand"),
    "forest": ("uttarakhand forest", "uttarakhand forest department", "uttarakhand forest guard", "uttarakhand forester", "uttarakhand forest service"),
    "police": ("uttarakhand police", "uk police", "uttarakhand police constable", "uttarakhand police si"),
}
STATE_PAGES = {
    "up-government-jobs": ("uttar pradesh", "up government", "up govt", "uppsc", "upsssc", "up police"),
    "bihar-jobs": ("bihar", "bpsc", "bihar police"),
    "rajasthan-jobs": ("rajasthan", "rpsc", "rajasthan police"),
    "mp-jobs": ("madhya pradesh", "mp government", "mp govt", "mppsc", "mp police"),
    "andhra-pradesh-jobs": ("andhra pradesh", "andhra", "ap government", "ap govt"),
    "arunachal-pradesh-jobs": ("arunachal pradesh", "arunachal"),
    "assam-jobs": ("assam", "apsc"),
    "chhattisgarh-jobs": ("chhattisgarh", "cgpsc", "cg govt"),
    "goa-jobs": ("goa government", "goa govt", "goa"),
    "gujarat-jobs": ("gujarat", "gpsc"),
    "haryana-jobs": ("haryana", "hpsc"),
    "himachal-pradesh-jobs": ("himachal pradesh", "hppsc"),
    "jharkhand-jobs": ("jharkhand", "jpsc"),
    "karnataka-jobs": ("karnataka", "kpsc"),
    "kerala-jobs": ("kerala", "kerala psc", "kpsc kerala"),
    "maharashtra-jobs": ("maharashtra", "mpsc"),
    "manipur-jobs": ("manipur", "mpsc manipur"),
    "meghalaya-jobs": ("meghalaya", "mpsc meghalaya"),
    "mizoram-jobs": ("mizoram", "mpsc mizoram"),
    "nagaland-jobs": ("nagaland", "npsc"),
    "odisha-jobs": ("odisha", "opsc", "odisha police"),
    "punjab-jobs": ("punjab", "ppsc"),
    "sikkim-jobs": ("sikkim", "spsc"),
    "tamil-nadu-jobs": ("tamil nadu", "tamilnadu", "tnpsc"),
    "telangana-jobs": ("telangana", "tspsc"),
    "tripura-jobs": ("tripura", "tpsc"),
    "west-bengal-jobs": ("west bengal", "wbpsc"),
}
RAW_CATEGORY = {
    "latest jobs": "latest-jobs", "latest job": "latest-jobs", "recruitment": "latest-jobs", "result": "result", "results": "result",
    "admit card": "admit-card", "admit cards": "admit-card", "answer key": "answer-key", "answer keys": "answer-key",
    "scholarship": "scholarship", "syllabus": "syllabus", "teaching exams": "teaching-exams", "teaching exam": "teaching-exams",
    "entrance exams": "entrance-exams", "entrance exam": "entrance-exams", "government schemes": "government-schemes",
    "government scheme": "government-schemes", "banking jobs": "banking", "banking": "banking", "railway jobs": "railway",
    "railway": "railway", "uttarakhand jobs": "uttarakhand-jobs", "central jobs": "central-government-jobs",
    "central government jobs": "central-government-jobs", "other state jobs": "other-state-jobs",
    "up government jobs": "up-government-jobs", "up jobs": "up-government-jobs", "bihar jobs": "bihar-jobs",
    "rajasthan jobs": "rajasthan-jobs", "mp jobs": "mp-jobs", "forest": "forest", "forest jobs": "forest", "police": "police",
    "police jobs": "police", "upsc": "upsc", "ssc": "ssc", "ctet": "ctet", "utet": "utet", "deled": "deled",
}
EXPLICIT_TYPES = {
    "admit-card": ("admit card", "hall ticket", "e-admit", "प्रवेश पत्र"),
    "answer-key": ("answer key", "answer-key", "उत्तर कुंजी"),
    "syllabus": ("syllabus", "पाठ्यक्रम"),
    "scholarship": ("scholarship", "छात्रवृत्ति"),
    "recruitment": ("recruitment", "vacancy", "apply online", "registration from", "applications are invited", "भर्ती", "विज्ञापन", "अधिसूचना"),
}
