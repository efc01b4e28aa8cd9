"""Texts on each side of the rules, built from the columns of ``part``, with the outcome that each must have.

The driver's text has no notice vocabulary, so the words of the rules are literal, and names, keys and addresses around
them come from the part: each row has a text of its own. The outcomes were worked out by hand from the rules' description
and not by this code; the SQL states them with the same columns in them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import dealt, table

KINDS = {"bool": "BOOLEAN", "int": "INTEGER", "string": "VARCHAR"}
#: What a part gives to texts: by Spark and by SQL.
SLOTS = {
    "name": (lambda: F.col("p_name"), "p_name"),
    "key": (lambda: F.col("p_partkey").cast("string"), "CAST(p_partkey AS VARCHAR)"),
    "host": (lambda: F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".in")), "'p' || p_partkey || '.in'"),
    "site": (lambda: F.concat(F.lit("www.p"), F.col("p_partkey").cast("string"), F.lit(".in")), "'www.p' || p_partkey || '.in'"),
    "blank": (lambda: F.repeat(F.lit(" "), (F.col("p_size") % 4).cast("int")), "repeat(' ', CAST(p_size % 4 AS INT))"),
}


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@dataclass(frozen=True)
class Cases:
    """``inputs`` and ``outputs`` name the columns of ``rows``, the inputs first; a part has the case of its key's remainder.

    ``fill`` puts a slot behind each whole word that it names, or in its place where the slot has an equals sign; ``tails`` puts
    one behind the texts of a column, where they are not empty.
    """

    inputs: str
    outputs: str
    rows: list[tuple]
    fill: dict[str, str] = field(default_factory=dict)
    tails: dict[str, str] = field(default_factory=dict)

    def parts(self, column: str, value: str) -> list[tuple[str, bool]]:
        """A literal as pieces: (text, False) or (slot, True)."""
        out: list[tuple[str, bool]] = []
        words = "|".join(map(re.escape, sorted(self.fill, key=len, reverse=True)))
        at = 0
        for m in re.finditer(rf"(?<![\w.])(?:{words})(?!\w)", value) if words else ():
            slot = self.fill[m[0]]
            out += [(value[at : m.start()], False), (slot[1:], True)] if slot[0] == "=" else [(value[at : m.end()] + " ", False), (slot, True)]
            at = m.end()
        out.append((value[at:], False))
        if value and column in self.tails:
            out += [("" if self.tails[column] == "blank" else " ", False), (self.tails[column], True)]
        return [x for x in out if x[0]] or [("", False)]

    def _column(self, column: str, value) -> Column:
        if value is None:
            return F.lit(None).cast("string")
        return F.concat(*(SLOTS[x][0]() if slot else F.lit(x) for x, slot in self.parts(column, str(value))))

    def _sql(self, column: str, value) -> str:
        if value is None or isinstance(value, (bool, int)):
            return "NULL" if value is None else str(value).lower()
        return " || ".join(SLOTS[x][1] if slot else quoted(x) for x, slot in self.parts(column, value))

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """``ord`` and the inputs, as strings; None is null."""
        names = self.inputs.split()
        which = (F.col("p_partkey") % len(self.rows) + 1).cast("int")
        pick = lambda i, n: F.element_at(F.array(*(self._column(n, r[i]) for r in self.rows)), which)
        part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
        return part.select(F.col("p_partkey").alias("ord"), *(pick(i, n).alias(n) for i, n in enumerate(names)))

    @property
    def sql(self) -> str:
        """``ord`` and the outcomes."""
        start = len(self.inputs.split())
        columns = []
        for i, name in enumerate(self.outputs.split(), start):
            given = next((r[i] for r in self.rows if r[i] is not None), "")
            kind = KINDS["bool" if isinstance(given, bool) else "int" if isinstance(given, int) else "string"]
            columns.append(f"CAST(list_extract([{', '.join(self._sql(name, r[i]) for r in self.rows)}], CAST(p_partkey % {len(self.rows)} AS INT) + 1) AS {kind}) AS {name}")
        return f"SELECT p_partkey AS ord, {', '.join(columns)} FROM part"


TITLES = Cases("title", "page parsed reader plain", [
    ("  Junior   Clerk || Exam ", "Junior Clerk   Exam", "Junior Clerk  Exam", "Junior Clerk Exam", "Junior Clerk || Exam"),
    ("1. Clerk Recruitment [Last Date: 05/01/2026]", "1. Clerk Recruitment [Last Date: 05/01/2026]", "1. Clerk Recruitment [Last Date: 05/01/2026]", "Clerk Recruitment", "Clerk Recruitment [Last Date: 05/01/2026]"),
    ("Officer posts Registration From 19-Aug-2026", "Officer posts Registration From 19-Aug-2026", "Officer posts Registration From 19-Aug-2026", "Officer posts", "Officer posts Registration From 19-Aug-2026"),
    ("Notice click here to apply", "Notice click here to apply", "Notice click here to apply", "Notice click here to apply", "Notice"),
    ("Click here for details", "Click here for details", "Click here for details", "", "Click here for details"),
    ("- Teacher Exam: ", "- Teacher Exam:", "Teacher Exam", "Teacher Exam", "Teacher Exam"),
    ("ऑनलाइन आवेदन के लिए क्लिक करें", "ऑनलाइन आवेदन के लिए क्लिक करें", "ऑनलाइन आवेदन के लिए क्लिक करें", "ऑनलाइन आवेदन के लिए क्लिक करें", "ऑनलाइन आवेदन"),
    ("", "", "", "", ""),
    (None, "", "", "", ""),
], fill={"Clerk": "name", "Officer": "name", "Teacher": "name", "Notice": "name"})

MOJIBAKE = Cases("x", "repaired", [
    ("Todayâ€™s notice", "Today’s notice"), ("Aâ€“B", "A–B"), ("Â£5", "£5"), ("zero​width", "zerowidth"), ("â€œquoteâ€", "“quote”"), ("plain", "plain"), ("", ""), (None, ""),
], tails={"x": "name", "repaired": "name"})

VALUES = Cases("x", "reader detail structured", [
    ("12 posts", "12 posts", "12 posts", "12 posts"), ("Not Mentioned", "", "Not Mentioned", "Not Mentioned"), (" - 5 -", "5", "5 -", "5"), ("See sitemap", "", "See sitemap", "See sitemap"),
    ("TBA", "", "TBA", "TBA"), ("| 12 posts;", "12 posts", "12 posts", "12 posts"), ("= Rs. 500.", "Rs. 500", "= Rs. 500.", "Rs. 500"), ("", "", "", ""),
], fill={"12": "=key", "sitemap": "name"})

DETAILS = Cases("x", "vacancy qualification salary age_limit application_fee last_date selection_process", [
    ("12 posts", True, True, False, True, True, False, True),
    ("as on 01.01.2026", False, False, False, False, False, False, False),
    ("Rs. 25", False, False, False, False, False, False, False),
    ("Rs. 35,400 - 1,12,400", True, True, True, True, True, False, True),
    ("Bachelor degree", False, True, False, False, False, False, True),
    ("05-01-2026", False, True, False, True, True, True, True),
    ("No fee", False, True, False, False, True, False, True),
    ("visit the website www.x.in", False, False, False, False, False, False, False),
    ("Official Notification", False, False, False, False, False, False, False),
    ("Level 7 pay", True, True, True, True, True, False, True),
    ("information regarding the exam", False, True, False, False, False, False, False),
    ("5 March 2026", True, True, False, True, True, True, True),
    (None, False, False, False, False, False, False, False),
], fill={"12": "=key", "degree": "name", "exam": "name"})

USABLE = Cases("x", "vacancy application_fee qualification", [
    ("12 posts", True, True, True), ("Available", False, False, False), ("see: check official notification", False, False, False), ("Free for all", False, True, True),
    ("Rs 100 www.x.in", True, False, True), ("BA", False, False, False), ("many posts", False, False, True), ("1234567", False, True, True),
], fill={"12": "=key", "many": "name", "all": "name"})

CORRUPT = Cases("x", "corrupt", [
    ("Rs. 35,400 per month", False), ("a^b^c", True), ("x`~y", True), ("depart ment Done", True), ("Jiw list", True), ("a^b", False), ("§¶•§¶•", True), ("§¶•§¶", False), ("", False),
], fill={"month": "name", "list": "name", "depart": "name"})

CANDIDATES = Cases("title", "candidate", [
    ("Junior Officer Recruitment 2026", True), ("Recruitment", False), ("Officer Recruitment 2025", False), ("Officer Recruitment syllabus 2026", False),
    ("Appointment of Vice Chancellor 2026", False), ("Appointment of Registrar 2026", False), ("Appointment of Registrar - apply online 2026", True),
    ("Contractual staff for the office", True), ("संविदा शिक्षक पद 2026", True), ("Officer meeting schedule 2026", False), ("Cut off marks recruitment 2026", False),
    ("Faculty posts act recruitment", False), ("Officer Recruitment 2025-2027", True), (None, False),
], fill={"Officer": "name", "staff": "name", "marks": "name", "Faculty": "name"})

ACTIVITY = Cases("title last_date description", "closed active", [
    ("Clerk post 2026", "05-05-2026", "", True, False), ("Clerk post 2026", "05-07-2026", "", False, True), ("Clerk post 2026", "Applications closed", "", True, False),
    ("Clerk post 2026", "", "Last date: 01/05/2026", True, False), ("Clerk post 2026", "", "Exam on 01/05/2026", False, True), ("View all", "", "", False, False),
    ("Clerk post 2026", "expired", "", True, False), ("Clerk post 2026", "2026-05-31", "", True, False), ("Clerk post 2026", "2026-06-01", "", False, True),
    ("Clerk post 2026", "registration is over", "", True, False), ("Clerk post 2026", "31-02-2026", "Closing date 10-05-2026", True, False), ("Key dates", "", "", False, False),
], fill={"Clerk": "name"})

FRESHNESS = Cases("title last_date scraped_at publish_date", "fresh", [
    ("Clerk 2024", "05-07-2026", "", "", True), ("Clerk 2026", "05-05-2026", "", "", False), ("Clerk 2025", "", "2026-05-30", "", False), ("Clerk 2026", "", "", "", True),
    ("Clerk", "", "2026-05-30", "", True), ("Clerk", "", "2026-01-01", "", False), ("Clerk", "", "", "2026-04-01", True), ("Clerk", "", "", "", False),
    ("Results", "", "2026-05-30", "", False), ("Clerk 2027", "", "2026-05-30", "", True), ("Clerk 2027", "", "", "", False), ("Clerk", "", "2026-01-01", "2026-05-30", False),
], fill={"Clerk": "name"})

PUBLIC = Cases("title category is_valid_post ai_model", "public", [
    ("Clerk post", "Recruitment", "true", "", True), ("Login", "x", "true", "", False), ("Clerk post", "Unknown", "true", "", False), ("Clerk post", "x", "false", "", False),
    ("Clerk post", "x", None, "", True), ("Clerk recruitment of officers 2026", "Recruitment", "true", "m", False), ("", "x", "true", "", False), ("Vacancy/NIA", "x", "true", "", False),
], fill={"Clerk": "name"})

PUBLISHED = Cases("notification_date publish_date title", "day", [
    ("2026-01-05", "", "", "2026-01-05"), ("5/1/26", "", "", "2026-01-05"), ("20260105", "", "", "2026-01-05"), ("", "03-02-2026", "", "2026-02-03"),
    ("", "", "Notification dated 7-3-2026", "2026-03-07"), ("", "", "none", "उपलब्ध नहीं"), ("soon", "05.01.2026", "", "उपलब्ध नहीं"), ("soon", "2026/1/5 10:00", "dated 1-1-2020", "2026-01-05"),
], fill={"none": "name"})

WRITTEN = Cases("x", "first archive newest last", [
    ("Exam 05-01-2026, last date: 10-02-2026", "10-02-2026", "Exam 05-01-2026, last date: 10-02-2026", 2026, 2026),
    ("Held on 5 March 2026", "5 March 2026", "Held on 5 March 2026", 2026, 2026), ("2026-1-5", "", "05-01-2026", 2026, 2026), ("no date", "", "no date", None, None),
    ("2027 and 2025", "", "2027 and 2025", 2027, 2025), ("deadline soon; 07/08/2026", "07/08/2026", "deadline soon; 07/08/2026", 2026, 2026),
], fill={"Exam": "name", "Held": "name", "no": "name", "and": "name"})

PAGE_TYPES = Cases("title category post_type", "kind", [
    ("Hall ticket out", "", "", "admit-card"), ("Clerk", "Answer Key", "", "answer-key"), ("Merit list 2026", "", "", "result"), ("Clerk", "", "Syllabus", "syllabus"),
    ("Fellowship", "Scholarship", "", "scholarship"), ("Walk-in for doctors", "", "", "interview"), ("Entrance test", "", "", "entrance"), ("Public notice", "", "", "notice"),
    ("Recruitment notice", "", "", "recruitment"), ("Clerk", "Teaching Jobs", "", "teaching"), ("Clerk", "", "", "recruitment"), ("Score card", "", "", "result"), ("सूचना", "", "", "notice"),
], fill={"Clerk": "name", "doctors": "name", "out": "name", "Fellowship": "name", "test": "name"})

STRICT = Cases("title category post_type last_date", "active", [
    ("Clerk post", "Recruitment", "", "05-07-2026", True), ("Clerk post", "Recruitment", "", "", False), ("Clerk result", "Recruitment", "", "05-07-2026", False),
    ("Clerk post", "x", "result", "05-07-2026", False), ("Clerk post", "x", "", "5/7/26", True), ("Clerk post", "x", "notice", "05-07-2026", False),
    ("Clerk post", "Jobs", "notice", "5 July 2026", True), ("Clerk post", "Recruitment", "", "01-06-2026", True), ("Clerk post", "Recruitment", "", "31-05-2026", False), ("Clerk post", "x", "", "2026-07-05", True),
], fill={"Clerk": "name"})

GENERIC = Cases("title url", "taken", [
    ("View student exam event page", "https://x.in/1", False), ("Officer recruitment notification 2026", "https://x.in/1", True), ("Exam notification", "https://x.in/1", False),
    ("Officer recruitment notification 2026", "https://x.in/1.pdf", False), ("Contact recruitment cell office", "https://x.in/1", False), ("Officer exam for all", "https://x.in/1", True),
    ("Support staff recruitment 2026", "https://x.in/1", False), ("Home", "https://x.in/1", False), ("Officer recruitment notification 2026", "mailto:a@x.in", False),
    ("Apply for online application form", "https://x.in/1", True), ("Officers of the board", "https://x.in/exam/1", True), ("Officers of the board", "https://x.in/1", False),
    ("{{name}} recruitment of officers", "https://x.in/1", False), ("Image gallery of exam hall", "https://x.in/1", False),
], fill={"Officer": "name", "Officers": "name", "x.in": "=host", "staff": "name", "gallery": "name"})

PDFS = Cases("t1 u1 t2 u2", "best first apply", [
    ("Download advertisement", "https://x.in/a.pdf", "Result", "https://x.in/r.pdf", "https://x.in/a.pdf", "https://x.in/a.pdf", None),
    ("Result", "https://x.in/r.pdf", "Recruitment notification", "https://x.in/n", "https://x.in/n", "https://x.in/r.pdf", None),
    ("Apply here", "https://x.in/p", "Apply online", "https://x.in/q", None, None, "https://x.in/q"),
    ("Detailed advertisement", "https://x.in/b.pdf", "Detailed advertisement of posts", "https://x.in/c.pdf", "https://x.in/c.pdf", "https://x.in/b.pdf", None),
    ("Contact", "https://x.in/c", "About", "https://x.in/d", None, None, None),
    ("Registration", "https://x.in/e", "Apply online", "https://x.in/f", None, None, "https://x.in/e"),
], fill={"x.in": "=host"})

METAS = Cases("html", "day", [
    ('<meta property="article:published_time" content="2026-01-02">', "2026-01-02"), ('<meta content="2026-01-03" property="article:published_time">', "2026-01-03"),
    ('<body>Notification dated 7-3-2026 <time datetime="2026-02-02">x</time></body>', "7-3-2026"), ('<time datetime="2026-02-02T10:00">x</time>', "2026-02-02T10:00"),
    ('<meta name="datePublished" content="">', ""), ('<meta name="author" content="2026-01-02">', ""), ("", ""),
    ('<meta name="x" content="2020"><meta name="publishDate" content="2026-04-05">', "2026-04-05"),
], tails={"html": "name"})

CARDS = Cases("title label context url root", "score", [
    # two words of the title 16 + 8, one site 8, PDF 45, advertisement 24, document 8
    ("Law Officer posts", "Law Officer advertisement", "", "https://x.in/f.pdf", "https://www.x.in/", 109),
    # advertisement 24, document 8 (notice), path 18, no word, other site
    ("Law Officer posts", "Read", "", "https://y.in/notification/notice", "https://x.in/", 50),
    # result -30 and -35, one site 8
    ("Law Officer posts", "Result", "", "https://x.in/r", "https://x.in/", -57),
    # chrome -40, one site 8
    ("Law Officer posts", "Contact us", "", "https://x.in/c", "https://x.in/", -32),
    # apply 5, registration path none, one word 8 + 4, one site 8, chrome for "register" none
    ("Law posts", "Apply now for law", "", "https://x.in/a", "https://x.in/", 25),
], fill={"x.in": "=host", "www.x.in": "=site", "Read": "name"})

OFFICIAL = Cases("title organisation label url", "pdf score", [
    # PDF 12, advertisement 20, role 25, word "law" 3, path "advt" 8
    ("Recruitment of Law Officer by BOB 2026", "bob", "Law Officer advertisement", "https://x.in/advt1.pdf", "https://x.in/advt1.pdf", 68),
    ("Recruitment of Law Officer by BOB 2026", "bob", "Result of law officer", "https://x.in/r.pdf", None, None),
    ("Recruitment of Law Officer by PNB 2026", "bob", "Law Officer advertisement", "https://x.in/advt1.pdf", None, None),
    # viewer 8, advertisement 20 and 14, words "indian" 3
    ("Indian Overseas Bank clerks", "indian overseas bank", "Detailed advertisement, Indian", "https://x.in/loadpdf?1", "https://x.in/loadpdf?1", 45),
    ("Overseas Indian bank", "indian overseas bank", "Detailed advertisement", "https://x.in/loadpdf?1", None, None),
], fill={"x.in": "=host", "2026": "name"})

SECTIONS = Cases("title category department last_date", "section strict", [
    ("Clerk post", "Uttarakhand Jobs", "", "05-07-2026", "AUTO_UK_JOBS", "AUTO_UK_JOBS"), ("Clerk post", "SSC", "", "05-07-2026", "AUTO_CENTRAL_JOBS", "AUTO_CENTRAL_JOBS"),
    ("Clerk post", "Recruitment", "Railway", "05-07-2026", "AUTO_CENTRAL_JOBS", "AUTO_CENTRAL_JOBS"), ("Clerk post", "Recruitment", "Police", "05-07-2026", "AUTO_STATE_JOBS", "AUTO_STATE_JOBS"),
    ("Clerk post", "Recruitment", "Police", "05-05-2026", "AUTO_STATE_JOBS", None), ("UKSSSC clerk post", "Recruitment", "", "05-07-2026", "AUTO_UK_JOBS", "AUTO_UK_JOBS"),
    ("Clerk result", "Recruitment", "Police", "05-07-2026", "AUTO_STATE_JOBS", None),
], fill={"Clerk": "name", "clerk": "name"})

SUMMARIES = Cases("title vacancy qualification salary last_date", "summary", [
    ("Clerk post [Last Date: 1/2/2026]", "12", "", "N/A", "05-07-2026", "Clerk post. Total vacancies: 12. Last date: 05-07-2026"), ("", "", "BA", "Rs 500", "", "Educational qualification: BA. Salary/Pay: Rs 500"),
    ("Clerk", "not mentioned", "unknown", "-", "TBA", "Clerk"), ("", "", "", "", "", ""),
], fill={"Clerk": "name", "BA": "name"})

HOLES = Cases("x", "merge gate editor reader detail structured page", [
    ("", True, True, True, False, True, True, True), ("N/A", True, True, True, True, True, True, True), ("-", False, True, False, True, False, True, True), ("=", False, False, False, False, False, True, False),
    ("official notification", True, False, False, False, True, False, True), ("TBA", False, False, False, True, False, False, False), ("12", False, False, False, False, False, False, False),
    ("Available", False, False, False, False, True, False, False), ("Not Specified", False, True, False, False, False, False, False), ("unknown", False, False, False, True, False, False, False),
], fill={"12": "=key"}, tails={"x": "blank"})

SCRIPTS = Cases("x", "script", [
    ("नमस्ते दुनिया", "hi"), ("বাংলা ভাষা", "bn"), ("ਪੰਜਾਬੀ", "pa"), ("ગુજરાતી", "gu"), ("தமிழ் மொழி", "ta"), ("తెలుగు", "te"), ("ಕನ್ನಡ", "kn"), ("മലയാളം", "ml"), ("English only", "hi"), ("த", "hi"), ("हि தமிழ்", "ta"),
], tails={"x": "name"})

GLYPHS = Cases("x", "joined", [
    ("विज्ञा पन संख्या में abc d", "विज्ञापन संख्या में abc d"), ("सहा यक पद के लिए", "सहायक पद के लिए"), ("no change here", "no change here"), ("", ""), ("पद में म", "पद में म"),
], tails={"x": "name", "joined": "name"})

MERGES = Cases("has_old o_title o_vacancy o_publish o_year has_new n_title n_vacancy n_publish n_notified n_year n_valid", "change title vacancy publish year", [
    # nothing of the compared fields differs, so year and publication date stay as they were
    ("1", "A", "5", "01-01-2026", "2025", "1", "A", "5", "02-02-2026", "", "2026", "true", "kept", "A", "5", "01-01-2026", "2025"),
    # a real vacancy replaces the old one; the old publication date stays without a source date
    ("1", "A", "5", "01-01-2026", "2025", "1", "A", "9", "02-02-2026", "", "2026", "true", "updated", "A", "9", "01-01-2026", "2026"),
    # a placeholder never erases a value, a new notification date is a change and the publication date
    ("1", "A", "5", "01-01-2026", "2025", "1", "A", "N/A", "", "03-03-2026", "2026", "true", "updated", "A", "5", "03-03-2026", "2026"),
    ("1", "A", "", "", "2025", "1", "B", "", "02-02-2026", "", "2026", "true", "updated", "B", "", "02-02-2026", "2026"),
    ("0", "", "", "", "", "1", "B", "7", "02-02-2026", "", "2026", "true", "added", "B", "7", "02-02-2026", "2026"),
    # a row marked invalid is left out
    ("1", "A", "5", "01-01-2026", "2025", "1", "B", "9", "02-02-2026", "", "2026", "false", "kept", "A", "5", "01-01-2026", "2025"),
    ("1", "A", "5", "01-01-2026", "2025", "0", "", "", "", "", "", "true", "kept", "A", "5", "01-01-2026", "2025"),
], tails={"o_title": "name", "n_title": "name", "title": "name"})

TEXTS = Cases("notification_text content description title", "reader structured page", [
    ("n", "c", "d", "t", "n c d t", "n c d t", "n c"), ("", "c", "", "t", "c t", "c t", "c"), (None, None, "d", None, "d", "d", ""), ("", "", "", "", "", "", ""),
], fill={"d": "name", "c": "name"})
