"""Rule classifiers: each is one CASE expression over lower-cased text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists as W
from .text import any_in, clean, has_any, has_word, is_garbled, placeholder, squeeze, strip, text

YEAR = r"\b20\d{2}\b"


def is_bad_url(url: Column | str) -> Column:
    """Empty, not http(s), of a blocked site, or with a path part of site chrome."""
    u = clean(url)
    return ~u.rlike("^https?://") | has_any(u, W.BAD_DOMAINS) | has_any(u, W.BAD_URL_PARTS)


def _specific_title(t: Column) -> Column:
    named = t.rlike(r"\b(?:post|posts|vacanc(?:y|ies)|advt?\.?\s*no\.?|notification\s*no\.?|no\.\s*\d{1,5})\b")
    return ~is_garbled(t) & (named | has_any(t, W.ROLE_TERMS) | t.rlike(YEAR) | has_any(t, W.SPECIFIC_PHRASES))


def _specific_result(t: Column) -> Column:
    landing = any_in(t, ("result", "results", "old result", "old results", "latest result"))
    return ~landing & ~has_any(t, W.NOT_A_RESULT) & (t.rlike(YEAR) | has_any(t, W.SPECIFIC_RESULT_PHRASES))


def _specific_exam(t: Column) -> Column:
    landing = any_in(t, ("exam", "examination", "today's exam", "todays exam"))
    return ~landing & (has_any(t, W.EXAM_TERMS) | (t.rlike(r"\b(?:exam|examination)\b") & t.rlike(YEAR)))


def classify_post(title: Column | str, url: Column | str, description: Column | str | None = None) -> Column:
    """Kind of a notice, or null for what is no specific notice.

    Rejections come first, then Admit Card, Answer Key, Result, Syllabus, Scholarship, Recruitment
    and Exam, the first that holds. Terms match as substrings, so "course" also rejects "of course".
    """
    t, u, d = clean(title), clean(url), clean(F.lit("") if description is None else description)
    rejected = (
        (F.length(t) < 8) | is_bad_url(u) | any_in(t, W.BAD_EXACT_TITLES) | has_any(t, W.BAD_PHRASES) | is_garbled(t)
    )
    specific, role = _specific_title(t), has_any(t, W.ROLE_TERMS)
    concrete = role | t.rlike(r"\b(?:post|posts|vacanc(?:y|ies))\b") | has_any(t, W.CONCRETE_PHRASES)
    hiring = has_any(t, W.RECRUITMENT_TERMS) & concrete & ~has_any(t, W.NOT_A_JOB)
    rescued = role & has_any(u, W.GOOD_URL_PARTS) & (has_any(d, W.RECRUITMENT_TERMS) | has_any(t, W.RESCUE_PHRASES))
    return (
        F.when(rejected, F.lit(None).cast("string"))
        .when(has_any(t, W.ADMIT_TERMS) & specific, "Admit Card")
        .when(has_any(t, W.ANSWER_TERMS) & specific, "Answer Key")
        .when(has_any(t, W.RESULT_TERMS) & _specific_result(t), "Result")
        .when(has_any(t, W.SYLLABUS_TERMS) & specific, "Syllabus")
        .when(has_any(t, W.SCHOLARSHIP_TERMS) & specific, "Scholarship")
        .when(hiring | rescued, "Recruitment")
        .when(_specific_exam(t), "Exam")
    )


def allow(title: Column | str, url: Column | str) -> Column:
    return classify_post(title, url).isNotNull()


def post_type(title: Column | str, category: Column | str) -> Column:
    """Kebab-case type from the title; the category decides only for a neutral title."""
    t, k = clean(title), clean(category)
    return (
        F.when(has_any(t, W.TYPE_ADMIT), "admit-card")
        .when(has_any(t, W.TYPE_ANSWER), "answer-key")
        .when(t.rlike(r"\b(result|merit list|score ?card|final result)\b") | t.rlike(r"(?<![\p{L}\p{M}\p{N}_])परिणाम(?![\p{L}\p{N}_])"), "result")
        .when(has_any(t, W.TYPE_SYLLABUS), "syllabus")
        .when(has_any(t, W.TYPE_SCHOLARSHIP), "scholarship")
        .when(has_any(t, W.TYPE_RECRUITMENT), "recruitment")
        .when(k.isin("admit card", "admit-card"), "admit-card")
        .when(k.isin("answer key", "answer-key"), "answer-key")
        .when(k.isin("result", "results"), "result")
        .when(k == "syllabus", "syllabus")
        .when(k == "scholarship", "scholarship")
        .when(k.isin("recruitment", "latest jobs", "latest job", "jobs", "job"), "recruitment")
        .otherwise("other")
    )


def department(source: Column | str, body: Column | str, existing: Column | str) -> Column:
    """Source map, organisation rules, department rules, an existing specific value, else empty."""
    s, b, e = F.lower(strip(source)), F.lower(text(body)), strip(existing)
    out = F.when(F.lit(False), "")
    for name, label in W.SOURCE_DEPARTMENTS.items():
        out = out.when(s == name, label)
    for rules in (W.ORGANISATION_RULES, W.DEPARTMENT_RULES):
        for label, words in rules.items():
            out = out.when(has_word(b, words), label)
    return out.when((e != "") & ~F.lower(e).isin(*W.GENERIC_DEPARTMENTS), e).otherwise("")


def home_category(raw: Column | str, body: Column | str, narrow: Column | str) -> Column:
    """Homepage category: location and sector signals, a meaningful explicit value, then the text."""
    given = F.when(strip(raw) == "", F.lit("Latest Jobs")).otherwise(strip(raw))
    b, n = F.lower(text(body)), F.lower(text(narrow))
    return (
        F.when(has_any(b, W.HOME_UK), "Uttarakhand Jobs")
        .when(has_any(b, W.HOME_RAILWAY), "Railway Jobs")
        .when(has_any(b, W.HOME_BANKING), "Banking Jobs")
        .when(F.lower(given).isin(*W.HOME_EXPLICIT), given)
        .when(has_any(n, ("admit card", "admit-card", "hall ticket", "प्रवेश पत्र")), "Admit Card")
        .when(has_any(n, ("answer key", "answer-key", "उत्तर कुंजी")), "Answer Key")
        .when(has_any(n, ("result", "परिणाम")), "Result")
        .when(has_any(n, ("scholarship", "छात्रवृत्ति")), "Scholarship")
        .when(has_any(n, ("syllabus", "पाठ्यक्रम")), "Syllabus")
        .otherwise(given)
    )


def is_noise(title: Column | str) -> Column:
    t = F.lower(squeeze(title))
    return (t == "") | t.rlike("(?i)" + W.NOISE_PATTERN) | t.isin(*W.NOISE_TITLES)


def salary_ok(value: Column | str) -> Column:
    s = F.lower(squeeze(value))
    return (s == "") | (~has_any(s, W.SALARY_NOT) & has_any(s, W.SALARY_TERMS) & ~s.rlike(r"[\^~`]{2,}|ment done|freq:|qv\^|f41q"))


def is_publishable(row: dict[str, Column]) -> Column:
    """Publication gate over the columns of a notice; columns not given are empty."""
    get = lambda k: squeeze(row.get(k, F.lit("")))
    real = lambda k: ~placeholder(get(k), W.GATE_PLACEHOLDERS)
    title, category = F.lower(get("title")), F.lower(F.coalesce(F.nullif(get("category"), F.lit("")), get("post_type")))
    ai = F.coalesce(row.get("ai_generated", F.lit(False)).cast("boolean"), F.lit(False)) | (get("ai_model") != "")
    body = lambda *ks: F.length(F.concat_ws(" ", *map(get, ks)))
    hiring_title = has_any(title, W.GATE_RECRUITMENT)
    hiring = has_any(category, ("recruit", "भर्ती")) | hiring_title
    grant = has_any(category, ("scholarship", "छात्रवृत्ति")) | title.contains("छात्रवृत्ति")
    details = sum(
        real(k).cast("int")
        for k in ("vacancy", "qualification", "age_limit", "application_fee", "selection_process", "last_date", "application_start_date", "salary")
    )
    linked = real("notification_pdf") | real("apply_link") | real("official_website")
    full = (
        (F.length(get("summary")) >= 120)
        & (F.length(get("intro")) >= 100)
        & (body("summary", "intro", "description", "content", "how_to", "important_notes") >= 380)
        & (details >= 2)
        & linked
    )
    return (
        F.when((F.length(title) < 20) | ~F.lower(get("url")).rlike("^https?:"), False)
        .when(has_any(title, W.GATE_BLOCKED), False)
        .when(~hiring & ai, grant & (body("summary", "intro", "description", "content", "how_to") >= 500) & real("official_website"))
        .when(~hiring, True)
        .when(~hiring_title | ~salary_ok(get("salary")), False)
        .when(ai, full)
        .otherwise(True)
    )


def generic_category(title: Column | str) -> Column:
    """Plural category names of the generic scan; Latest Jobs by default."""
    t = clean(title)
    return (
        F.when(has_any(t, W.GENERIC_ADMIT), "Admit Card")
        .when(has_any(t, W.GENERIC_RESULT), "Results")
        .when(has_any(t, W.GENERIC_ANSWER), "Answer Key")
        .when(has_any(t, W.GENERIC_SYLLABUS), "Syllabus")
        .when(has_any(t, W.GENERIC_SCHOLARSHIP), "Scholarship")
        .when(has_any(t, W.GENERIC_SCHEME), "Government Schemes")
        .otherwise("Latest Jobs")
    )


def editor_type(title: Column | str) -> Column:
    """The editor's nine kebab-case types; a notice by default."""
    t = clean(title)
    return (
        F.when(has_any(t, W.EDITOR_ADMIT), "admit-card")
        .when(has_any(t, W.TYPE_ANSWER), "answer-key")
        .when(t.rlike(r"\b(result|results|merit list|score card|scorecard)\b") | t.contains("परिणाम"), "result")
        .when(has_any(t, ("syllabus", "पाठ्यक्रम")), "syllabus")
        .when(has_any(t, W.SCHOLARSHIP_TERMS), "scholarship")
        .when(has_any(t, W.EDITOR_ENTRANCE), "entrance")
        .when(has_any(t, W.EDITOR_INTERVIEW), "interview")
        .when(has_any(t, W.EDITOR_NOTICE) & ~has_any(t, W.EDITOR_APPLY), "notice")
        .when(has_any(t, W.EDITOR_RECRUITMENT), "recruitment")
        .otherwise("notice")
    )


def category_noise(title: Column | str, body: Column | str) -> Column:
    """Titles and error pages that no category page shows."""
    t, b = F.lower(squeeze(title)), F.lower(text(body))
    return t.isin(*W.CATEGORY_NOISE) | (F.length(t) < 12) | has_any(b, W.ERROR_PAGES) | has_any(t, W.CHROME)


def latest_eligible(title: Column | str, kind: Column | str, category: Column | str, last: Column, as_of: str) -> Column:
    """A recruitment whose deadline is missing or has not passed, by type or category, and no other type by title."""
    t, k, g = (F.lower(strip(x)) for x in (title, kind, category))
    hiring = k.isin("recruitment", "job", "jobs", "") | g.isin("recruitment", "latest jobs", "latest job")
    return hiring & ~has_any(t, W.NOT_LATEST) & F.coalesce(last >= F.to_date(F.lit(as_of)), F.lit(True))


def hindi_share(x: Column | str) -> Column:
    """Devanagari characters among Latin and Devanagari ones."""
    letters = F.length(F.regexp_replace(text(x), "[^A-Za-z\u0900-\u097F]", ""))
    return F.length(F.regexp_replace(text(x), "[^\u0900-\u097F]", "")) / F.greatest(letters, F.lit(1))


def edited_well(row: dict[str, Column]) -> Column:
    """Quality gate of an edited article: lengths, Hindi share, key points, questions, blocked words and type."""
    get = lambda k: squeeze(row.get(k, F.lit("")))
    body = F.concat_ws(" ", *map(get, ("summary", "intro", "how_to", "important_notes")))
    kind = F.lower(F.coalesce(F.nullif(get("post_type"), F.lit("")), get("category")))
    size = lambda k: F.coalesce(F.size(row[k]), F.lit(0)) if k in row else F.lit(0)
    return (
        (F.length(get("title")) >= 20)
        & (F.length(get("summary")) >= 120)
        & (F.length(get("intro")) >= 100)
        & (hindi_share(body) >= 0.38)
        & (size("key_points") >= 4)
        & (size("faq") >= 3)
        & ~get("summary").rlike(r"(?i)\b(?:Government|Candidates|Important Dates|Apply Online|Job Details)\b")
        & ~has_any(F.lower(F.concat_ws(" ", get("title"), body)), W.EDITED_BLOCKED)
        & ((kind == "") | has_any(kind, ("recruitment", "भर्ती", "vacancy", "रिक्ति")))
    )


def page_type(title: Column | str, category: Column | str, kind: Column | str) -> Column:
    """Type of a rendered page, from category, title and type together; a recruitment by default."""
    t, raw = F.lower(text(title)), F.lower(text(category))
    blob = F.concat_ws(" ", raw, t, F.lower(text(kind)))
    return (
        F.when(blob.contains("admit") | has_any(t, ("hall ticket", "call letter", "प्रवेश पत्र")), "admit-card")
        .when(blob.contains("answer") | t.contains("उत्तर कुंजी"), "answer-key")
        .when(blob.contains("result") | t.rlike(r"\bmerit list\b|\bscore ?card\b|परिणाम"), "result")
        .when(blob.contains("syllabus") | t.contains("पाठ्यक्रम"), "syllabus")
        .when(blob.contains("scholarship") | t.contains("छात्रवृत्ति"), "scholarship")
        .when(has_any(blob, ("interview", "walk-in")) | has_any(t, ("वॉक-इन", "साक्षात्कार")), "interview")
        .when(blob.contains("entrance") | t.contains("प्रवेश परीक्षा"), "entrance")
        .when(has_any(blob, W.PAGE_NOTICE) & ~has_any(t, W.PAGE_HIRING), "notice")
        .when(has_any(raw, ("teaching", "teacher")), "teaching")
        .otherwise("recruitment")
    )


def is_recruitment(title: Column | str, category: Column | str, kind: Column | str) -> Column:
    """Strict form: a type or category of hiring, and no other type by name or title."""
    t, g, p = (F.lower(squeeze(x)) for x in (title, category, kind))
    other = p.isin("result", "admit card", "answer key", "syllabus", "scholarship", "other")
    titled = has_any(t, ("admit card", "hall ticket", "answer key", "result", "syllabus", "scholarship", "पाठ्यक्रम", "प्रवेश पत्र", "परिणाम", "उत्तर कुंजी"))
    return ~other & ~titled & (p.isin("recruitment", "job", "jobs", "") | g.isin("recruitment", "latest jobs", "latest job", "job", "jobs"))
