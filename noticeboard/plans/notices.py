"""Notices over the driver's tables, and the SQL of the same rows.

The driver's text has no notice vocabulary, so titles are synthetic: templates below, filled
with part names. Each template aims at one outcome of the rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import dealt, table

#: (title with # for the name, url, source, raw category, description)
TEMPLATES = (
    ("Junior Officer Recruitment 2026 - #", "https://example.gov.in/recruitment/notice.pdf", "ssc", "Recruitment", "Applications are invited for the post of junior officer"),
    ("Admit Card for # Constable Exam 2026", "https://police.example.in/admit-card/1", "board", "Latest Jobs", "Hall ticket of the exam"),
    ("Answer Key of # Teacher Test 2025", "https://example.org/answer-key/2", "upsc", "Answer Key", "Provisional answer key"),
    ("Result of # Examination 2026 declared", "https://example.gov.in/result/3", "rpsc", "Results", "Merit list and score card"),
    ("Syllabus for # Assistant Posts", "https://example.gov.in/syllabus/4", "", "Syllabus", "Indicative syllabus and exam pattern"),
    ("# Scholarship 2026 for research fellow", "https://example.edu/scholarship/5", "nsp", "Scholarship", "Financial assistance"),
    ("Click here for # details", "https://example.gov.in/6", "", "", ""),
    ("Recruitment", "https://example.gov.in/recruitment", "ukpsc", "Recruitment", ""),
    ("# course of studies 2026", "https://example.gov.in/7", "", "Latest Jobs", "A course"),
    ("IBPS # Manager Vacancy 2026 apply online", "https://ibps.example.in/jobs/8", "ibps", "Banking Jobs", "Bank recruitment, online application"),
    ("UKSSSC # Clerk Recruitment of 12 posts", "https://sssc.uk.gov.in/9", "uksssc", "SSC", "Uttarakhand group C"),
    ("SSC # Stenographer notification no. 7", "https://ssc.example.in/notification/10", "other", "SSC", "Selection post of government of india"),
    ("BPSC Bihar # Lecturer engagement 2024", "https://bpsc.bih.nic.in/11", "bpsc", "Other State Jobs", "Bihar government lecturer"),
    ("# Exam schedule 2026", "https://example.gov.in/exam/12", "", "Exam", "Date sheet"),
    ("Railway RRB # Technician Recruitment 2027", "https://rrb.example.in/13", "railway", "Railway Jobs", "Railway vacancy"),
    ("Hospital # Nurse Recruitment 2026", "ftp://example.gov.in/14", "aiims", "Recruitment", "AIIMS nurse posts"),
    ("Old # Driver list", "https://ndtv.com/recruitment/15", "news", "Latest Jobs", "vacancy"),
    ("Forest Guard # Driver list", "https://example.gov.in/career/16", "board", "Forest", "Forest department vacancy for drivers"),
    ("Marks of the candidates # Recruitment of Officer", "https://example.gov.in/17", "upsc", "Result", "marks"),
    ("More", "https://example.gov.in/18", "", "", ""),
    ("UPSC Civil Services # Examination 2026", "https://upsc.gov.in/examination/19", "upsc", "UPSC", "Union public service commission"),
    ("# Government Scheme yojana 2026", "https://example.gov.in/20", "", "Government Schemes", "A scheme"),
    ("CTET # Teacher eligibility 2026", "https://example.gov.in/21", "ctet", "Teaching Exams", "ctet tet"),
)
COLUMNS = ("title", "url", "source", "category", "description")
COUNT = len(TEMPLATES)


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One notice a part: ``ord`` and the template's columns."""
    part = dealt(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("name"), F.col("p_size").alias("size")), "ord")
    which = (F.col("ord") % COUNT + 1).cast("int")

    def pick(i: int) -> Column:
        return F.element_at(F.array(*(F.lit(t[i]) for t in TEMPLATES)), which)

    title = F.replace(pick(0), F.lit("#"), F.col("name"))
    return part.select("ord", title.alias("title"), *(pick(i).alias(c) for i, c in enumerate(COLUMNS) if i), "size")


def _list(i: int) -> str:
    return "[" + ", ".join(quoted(t[i]) for t in TEMPLATES) + "]"


SQL = (
    "SELECT p_partkey AS ord, replace(list_extract(" + _list(0) + f", CAST(p_partkey % {COUNT} AS INT) + 1), '#', p_name) AS title, "
    + ", ".join(f"list_extract({_list(i)}, CAST(p_partkey % {COUNT} AS INT) + 1) AS {c}" for i, c in enumerate(COLUMNS) if i)
    + ", p_size AS size FROM part"
)


def any_of(column: str, terms) -> str:
    """SQL of "contains one of the terms"."""
    return "(" + " OR ".join(f"contains({column}, {quoted(t)})" for t in terms) + ")"


def one_of(column: str, values) -> str:
    return f"({column} IN (" + ", ".join(map(quoted, values)) + "))"


def whole_word(column: str, words) -> str:
    """SQL of "one of the words, not inside a longer run of letters"; no look-behind is needed."""
    import re

    return f"regexp_matches({column}, " + quoted("(^|[^a-z])(" + "|".join(re.escape(w).replace(r"\ ", " ") for w in words) + ")([^a-z]|$)") + ")"


def signals(column: str, terms) -> str:
    import re

    plain = [t for t in terms if re.fullmatch(r"[a-z0-9]+", t)]
    rest = [t for t in terms if t not in plain]
    tests = []
    if plain:
        tests.append(f"regexp_matches({column}, " + quoted("(^|[^a-z0-9])(" + "|".join(plain) + ")([^a-z0-9]|$)") + ")")
    tests += [f"contains({column}, {quoted(t)})" for t in rest]
    return "(" + " OR ".join(tests) + ")"


def clean_sql(x: str) -> str:
    return f"regexp_replace(lower(trim({x})), '\\s+', ' ', 'g')"


def escaped(x: str) -> str:
    """SQL of a text with HTML's five signs escaped."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{old}', '{new}')"
    return x
