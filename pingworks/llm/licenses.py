"""License scan: ordered signature rules, evaluated by Spark expressions alone.

A rule is a regular expression with a keyword, a priority and a confidence.  A text
is first held against one keyword pattern; only texts that pass meet the rules whose
keyword they hold.  Detections inside a detection of the same or a better priority
are suppressed, so "GNU Lesser General Public License v2.1" is one finding, not three.
All of it happens row by row inside the scan stage: no join, no shuffle, no Python.

Defined cases: a null text is an empty one (no words, no labels, score 0); of rules
that find the same interval the better priority wins, then the earlier rule; repeated
rows are scanned one by one; other columns pass through, but one that bears the name of
a result (n_words, labels, score, detections, ...) is replaced by it; helper columns
carry a ``__l_`` prefix; an empty table gives an empty table.  Texts of any length cost
their length and their number of detections, see `_before`."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pingworks.llm.license_rules import signatures

# Words of a text whose A-Z still stand: letters, digits, everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases of the base search and their labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

# License families as (identifier, name pattern, versions, keyword).
# A version "" means that the name stands alone.
FAMILIES = [
    ("mit", r"(?:the\s+)?(?:mit|expat)\s+licen[cs]e", [""], "licen"),
    ("mit-0", r"mit\s+no\s+attribution\s+licen[cs]e", [""], "licen"),
    ("apache", r"apache\s+(?:software\s+)?licen[cs]e", ["1.0", "1.1", "2.0"], "apache"),
    ("gpl", r"(?:gnu\s+)?general\s+public\s+licen[cs]e", ["1", "2", "3"], "public"),
    ("lgpl", r"(?:gnu\s+)?(?:lesser|library)\s+general\s+public\s+licen[cs]e", ["2", "2.1", "3"], "public"),
    ("agpl", r"(?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e", ["1", "3"], "public"),
    ("gfdl", r"(?:gnu\s+)?free\s+documentation\s+licen[cs]e", ["1.1", "1.2", "1.3"], "documentation"),
    ("mpl", r"mozilla\s+public\s+licen[cs]e", ["1.0", "1.1", "2.0"], "mozilla"),
    ("epl", r"eclipse\s+public\s+licen[cs]e", ["1.0", "2.0"], "eclipse"),
    ("cpl", r"common\s+public\s+licen[cs]e", ["1.0"], "public"),
    ("cddl", r"common\s+development\s+and\s+distribution\s+licen[cs]e", ["1.0", "1.1"], "distribution"),
    ("eupl", r"european\s+union\s+public\s+licen[cs]e", ["1.0", "1.1", "1.2"], "european"),
    ("bsd-2-clause", r"(?:simplified|2-clause|two-clause|freebsd)\s+bsd\s+licen[cs]e|bsd\s+2-clause", [""], "bsd"),
    ("bsd-3-clause", r"(?:new|revised|modified|3-clause|three-clause)\s+bsd\s+licen[cs]e|bsd\s+3-clause", [""], "bsd"),
    ("bsd-4-clause", r"(?:original|4-clause|four-clause)\s+bsd\s+licen[cs]e|bsd\s+4-clause", [""], "bsd"),
    ("0bsd", r"(?:zero-clause\s+bsd|bsd\s+zero\s+clause)(?:\s+licen[cs]e)?", [""], "bsd"),
    ("bsd", r"bsd\s+licen[cs]e", [""], "bsd"),
    ("isc", r"isc\s+licen[cs]e", [""], "isc"),
    ("artistic", r"artistic\s+licen[cs]e", ["1.0", "2.0"], "artistic"),
    ("bsl", r"boost\s+software\s+licen[cs]e", ["1.0"], "boost"),
    ("busl", r"business\s+source\s+licen[cs]e", ["1.1"], "business"),
    ("sspl", r"server\s+side\s+public\s+licen[cs]e", ["1"], "server"),
    ("elastic", r"elastic\s+licen[cs]e", ["1", "2.0"], "elastic"),
    ("unlicense", r"the\s+unlicense|unlicense", [""], "unlicense"),
    ("wtfpl", r"do\s+what\s+the\s+\S+\s+you\s+want\s+to\s+public\s+licen[cs]e|wtfpl", [""], "want"),
    ("zlib", r"zlib(?:/libpng)?\s+licen[cs]e", [""], "zlib"),
    ("libpng", r"libpng\s+licen[cs]e", ["2.0"], "libpng"),
    ("ofl", r"(?:sil\s+)?open\s+font\s+licen[cs]e", ["1.0", "1.1"], "font"),
    ("osl", r"open\s+software\s+licen[cs]e", ["1.0", "2.0", "2.1", "3.0"], "open"),
    ("afl", r"academic\s+free\s+licen[cs]e", ["1.1", "1.2", "2.0", "2.1", "3.0"], "academic"),
    ("ms-pl", r"microsoft\s+public\s+licen[cs]e", [""], "microsoft"),
    ("ms-rl", r"microsoft\s+reciprocal\s+licen[cs]e", [""], "microsoft"),
    ("python", r"python\s+(?:software\s+foundation\s+)?licen[cs]e", ["2.0"], "python"),
    ("php", r"php\s+licen[cs]e", ["3.0", "3.01"], "php"),
    ("ruby", r"ruby\s+licen[cs]e", [""], "ruby"),
    ("postgresql", r"postgresql\s+licen[cs]e", [""], "postgresql"),
    ("ncsa", r"(?:university\s+of\s+illinois/?)?ncsa\s+open\s+source\s+licen[cs]e", [""], "ncsa"),
    ("openssl", r"openssl\s+licen[cs]e", [""], "openssl"),
    ("qpl", r"q\s+public\s+licen[cs]e", ["1.0"], "public"),
    ("zpl", r"zope\s+public\s+licen[cs]e", ["1.1", "2.0", "2.1"], "zope"),
    ("w3c", r"w3c\s+(?:software\s+notice\s+and\s+)?licen[cs]e", [""], "w3c"),
    ("vim", r"vim\s+licen[cs]e", [""], "vim"),
    ("x11", r"x11\s+licen[cs]e", [""], "x11"),
    ("ecl", r"educational\s+community\s+licen[cs]e", ["1.0", "2.0"], "educational"),
    ("upl", r"universal\s+permissive\s+licen[cs]e", ["1.0"], "universal"),
    ("odbl", r"open\s+(?:data\s+commons\s+open\s+)?database\s+licen[cs]e", ["1.0"], "database"),
    ("odc-by", r"open\s+data\s+commons\s+attribution\s+licen[cs]e", ["1.0"], "commons"),
    ("pddl", r"public\s+domain\s+dedication\s+and\s+licen[cs]e", ["1.0"], "domain"),
    ("ogl-uk", r"open\s+government\s+licen[cs]e", ["1.0", "2.0", "3.0"], "government"),
    ("cecill", r"cecill(?:-[bc])?(?:\s+licen[cs]e)?", ["1.0", "2.0", "2.1"], "cecill"),
    ("mulan", r"mulan\s+(?:permissive|public)\s+(?:software\s+)?licen[cs]e", ["1", "2"], "mulan"),
    ("openrail", r"openrail(?:-?[+m]{1,2})?(?:\s+licen[cs]e)?", [""], "openrail"),
]
# Elements of Creative Commons licenses, and their versions.
COMMONS = {
    "by": r"attribution",
    "by-sa": r"attribution[-\s]+share\s?alike",
    "by-nd": r"attribution[-\s]+no\s?deriv(?:ative)?s?",
    "by-nc": r"attribution[-\s]+non\s?-?commercial",
    "by-nc-sa": r"attribution[-\s]+non\s?-?commercial[-\s]+share\s?alike",
    "by-nc-nd": r"attribution[-\s]+non\s?-?commercial[-\s]+no\s?deriv(?:ative)?s?",
}
COMMONS_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
# Notices that name no license, as (label, pattern, keyword).
NOTICES = [
    ("all-rights-reserved", r"all\s+rights\s+reserved", "rights"),
    ("copyright", r"(?:copyright|\(c\)|©)\s+(?:\(c\)\s+|©\s+)?(?:19|20)\d\d", "(c)|copyright|©"),
    ("public-domain", r"(?:released|placed|dedicated)\s+(?:in|into|to)\s+the\s+public\s+domain", "domain"),
    ("cc0", r"(?:cc0|creative\s+commons\s+zero)(?:[-\s]+(?:v|version\s*)?1\.0)?", "cc0|zero"),
    ("mit", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge,\s+to\s+any\s+person", "hereby"),
    ("bsd", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms", "redistribution"),
    ("isc", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software", "permission"),
    ("proprietary", r"(?:confidential\s+and\s+proprietary|proprietary\s+and\s+confidential)", "proprietary"),
    ("no-redistribution", r"(?:may|must)\s+not\s+be\s+(?:copied|reproduced|redistributed)\s+without", "without"),
]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int  # 1 is best
    confidence: float


def rules() -> list[Rule]:
    """The ordered rule list: signatures written out one by one; then names spelled out
    from the families: for each version a declared tag, a grant, and a name with its
    number, and names without one; then notices."""
    version = lambda v: v.replace(".", r"\.") + (r"(?:\.0)?" if "." not in v else "") + r"(?!\.?\d)"
    sep = r"\s*,?\s*\(?(?:v|ver\.?|version)?\s*"
    tag = r"spdx-license-identifier:\s*"
    grant = r"(?:licen[cs]ed|released|distributed|available|provided)\s+under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?"
    out = [Rule(label, pattern, keywords, priority, confidence) for label, priority, confidence, keywords, pattern, _ in signatures()]
    for key, name, versions, word in FAMILIES:
        for v in versions:
            label = f"{key}-{v}" if v else key
            number = sep + version(v) if v else ""
            short = re_escape(key) + (r"-" + version(v) if v else "") + r"(?:-only|-or-later|\+)?(?![\w.-]*\w)"
            out.append(Rule(label, tag + short, ("spdx",), 1, 1.0))
            out.append(Rule(label, grant + f"(?:{name})" + number, (word,), 1 if v else 2, 0.95))
            out.append(Rule(label, f"(?<!{WORD})(?:{name})" + number + f"(?!{WORD})", (word,), 2 if v else 3, 0.9))
        if versions != [""]:
            out.append(Rule(key, grant + f"(?:{name})" + f"(?!{WORD})", (word,), 2, 0.8))
            out.append(Rule(key, f"(?<!{WORD})(?:{name})" + f"(?!{WORD})", (word,), 3, 0.7))
    for key, name in COMMONS.items():
        for v in COMMONS_VERSIONS:
            label = f"cc-{key}-{v}"
            out.append(Rule(label, tag + re_escape(label) + r"(?![\w.-]*\w)", ("spdx",), 1, 1.0))
            out.append(Rule(label, rf"(?<!{WORD})cc[-\s]+{key}[-\s]+(?:v|version\s*)?{version(v)}", ("cc",), 1, 0.95))
            out.append(Rule(label, rf"creative\s+commons\s+{name}(?:\s+licen[cs]e)?{sep}{version(v)}", ("commons",), 1, 0.95))
            out.append(Rule(label, rf"creativecommons\.org/licenses/{key}/{version(v)}", ("creativecommons",), 1, 1.0))
        out.append(Rule(f"cc-{key}", rf"(?<!{WORD})cc[-\s]+{key}(?![-\s]*(?:{WORD}|\.\d))", ("cc",), 2, 0.8))
        out.append(Rule(f"cc-{key}", rf"creative\s+commons\s+{name}(?!{WORD})", ("commons",), 2, 0.8))
    out += [Rule(label, p, tuple(k.split("|")), 3 if label in ("mit", "bsd", "isc", "cc0") else 4, 0.5) for label, p, k in NOTICES]
    return [replace(r, pattern=r.pattern.replace(r"\s+", BLANKS)) for r in out]


def re_escape(x: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in x)


#: Whatever a rule finds holds one of these; texts without are not scanned.
GATE = (
    r"(?i)licen[cs]|spdx|copyright|\(c\)|©|cc0|(?<![a-z])cc[-\s]|creative\s*commons|rights\s+reserved|public\s+domain|hereby|redistribut|permission|proprietary|openrail|cecill|wtfpl|without|bsd"
    # at the start of a word, so that most places are passed over at once
    r"|(?<![a-z])(?:(?:[al]?gpl|mpl|epl|cpl|osl|afl|ecl|sspl|busl|bsl|ofl|gfdl|psf|apl|asl)[- ]?v?\d|(?:cddl|eupl|odbl|odc-by|dl-de|etalab|psfl)(?:v|version)?(?![a-z])|mit(?:-0|\s+(?:or|and))|(?:or|and)\s+mit"
    r"|apache|software\s+is\s+provided|liable\s+for|endorse\s+or|advertising\s+materials|in\s+advertising|misrepresented|altered\s+(?:source|from)|suitability|classpath|llvm|gcc|special\s+exception|acknowledgment"
    r"|terms\s+as|unencumbered|unauthori[sz]ed\s|trade\s+secret|(?:gnu|eclipse|mozilla|unlicense|opendatacommons|sil)\.org|open\s?rail|creativeml|bigscience|bigcode|non-?commercial|change\s+date|use\s+grant"
    r"|you\s+just|independent\s+jpeg|sam\s+leffler|reserved\s+font|product\s+includes|imagemagick|polyform|blueoak|unicode-|(?:states|s\.)\s+government|perlfoundation|statically\s+or|illinois|limiting\s+other"
    r"|beer-?ware|a\s+beer|not\s+evil|gemma\s+terms|elastic(?:-2|\.co)|curl\.)"
)
#: Blanks between the words of a rule; they may hold the marks that begin comment lines.
BLANKS = r"\s+(?:[*#/;%!>|-]{1,4}\s+)*"
GATE = GATE.replace(r"\s+", BLANKS)
PRIORITIES = 4


def _phrase(p: str) -> str:
    return f"(?i)(?<!{WORD})" + GAP.join(p.split()) + f"(?!{WORD})"


_ALL_PHRASES = f"(?i)(?<!{WORD})(?:" + "|".join(GAP.join(p.split()) for p in PHRASES.values()) + f")(?!{WORD})"


GROUP = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _before(items: Column, kind: str, zero: Column, fold: Callable, merge: Callable, body: Callable) -> Column:
    """For each of ``items``: ``body(item, fold of all items before it)``.  Items fold by
    groups: what is before a group is kept for each group, and the rest of the way is
    GROUP steps at most, so that an array costs its length, not its square."""
    part = lambda xs, g, n: F.slice(xs, g * GROUP + 1, n)
    groups = lambda xs: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(xs) - 1, 6)), lambda g: F.aggregate(part(xs, g, F.lit(GROUP)), zero, fold))
    start = F.struct(zero.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    sums = lambda xs: F.aggregate(groups(xs), start, lambda acc, g: F.struct(merge(acc["at"], g).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    each = lambda s: F.transform(
        s["xs"], lambda x, k: body(x, F.aggregate(part(s["xs"], F.shiftright(k, 6), k.bitwiseAND(F.lit(GROUP - 1))), F.get(s["sums"], F.shiftright(k, 6)), fold))
    )
    return _let(items, lambda xs: F.when(F.size(xs) > 0, _let(F.struct(xs.alias("xs"), sums(xs).alias("sums")), each)))


def _intervals(text: Column, rule: Column) -> Column:
    """Places where a rule's pattern matches, as structs that sort for `_suppress`."""
    sizes = F.zip_with(
        F.split(text, rule["pattern"], -1), F.regexp_extract_all(text, rule["pattern"], F.lit(0)), lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("size"))
    )

    def place(x: Column, at: Column) -> Column:
        start = at + x["gap"]
        return F.struct(
            start.alias("start"), (-(start + x["size"])).alias("back"), rule["priority"].alias("priority"), rule["rule"].alias("rule"),
            rule["label"].alias("label"), rule["confidence"].alias("confidence"),
        )

    add = lambda acc, x: acc + x["gap"] + x["size"]
    return _before(F.filter(sizes, lambda x: x["size"].isNotNull()), "int", F.lit(0), add, lambda a, b: a + b, place)


def _suppress(places: Column) -> Column:
    """Keeps the places that lie in no place of the same or a better priority.

    Sorted by start, longest first, then priority and rule, whatever contains a
    place stands before it; so the furthest end so far, by priority, decides."""
    levels = range(1, PRIORITIES + 1)
    zero = F.array(*[F.lit(-1) for _ in levels])
    further = lambda acc, x: F.array(*[F.greatest(F.get(acc, F.lit(p - 1)), F.when(x["priority"] <= p, -x["back"]).otherwise(-1)) for p in levels])
    furthest = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y))

    def judged(x: Column, reach: Column) -> Column:
        end = -x["back"]
        item = F.struct(x["start"].alias("start"), end.alias("end"), x["label"].alias("label"), x["confidence"].alias("confidence"))
        return F.when(F.get(reach, x["priority"] - 1) < end, item)

    return F.array_compact(_before(F.sort_array(places), "array<int>", zero, further, furthest, judged))


def scan(docs: DataFrame, text: str = "text", rule_list: list[Rule] | None = None) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels,
    score, and ``detections``: kept places (start, end in code points, label,
    confidence)."""
    listed = [
        {"keywords": list(r.keywords), "pattern": "(?i)" + r.pattern, "label": r.label, "priority": r.priority, "confidence": r.confidence, "rule": i}
        for i, r in enumerate(rules() if rule_list is None else rule_list)
    ]
    kind = "array<struct<keywords:array<string>,pattern:string,label:string,priority:int,confidence:double,rule:int>>"
    table = F.from_json(F.lit(json.dumps(listed)), kind)  # one constant to the planner
    words = lambda c: F.regexp_count(c, F.lit(WORD + "+"))
    df = docs.withColumn("__l_text", F.coalesce(F.col(text), F.lit("")))
    body = F.col("__l_text")
    df = df.withColumns({"n_words": words(body).cast("long"), "__l_low": F.when(body.rlike(GATE), F.lower(body))})
    low = F.col("__l_low")
    df = df.withColumns({
        "__l_parts": F.when(low.contains("license"), F.split(body, _ALL_PHRASES, -1)),
        "__l_last": F.when(low.contains("license"), F.get(F.reverse(F.regexp_extract_all(body, F.lit(_ALL_PHRASES), F.lit(0))), F.lit(0))),
        "__l_rules": F.when(low.isNotNull(), F.filter(table, lambda r: F.exists(r["keywords"], lambda k: F.contains(low, k)))),
    })
    n_base = F.when(F.col("__l_parts").isNull(), 0).otherwise(F.size("__l_parts") - 1)
    df = df.withColumns({
        "n_base": n_base.cast("long"),
        "__l_places": F.flatten(F.filter(F.transform("__l_rules", lambda r: _intervals(body, r)), lambda x: x.isNotNull())),
    })
    df = df.withColumn("detections", F.coalesce(_suppress(F.col("__l_places")), F.array().cast("array<struct<start:int,end:int,label:string,confidence:double>>")))
    some, parts = F.col("n_base") > 0, F.col("__l_parts")
    base = F.array_compact(F.array(*[F.when(some & body.rlike(_phrase(p)), F.lit(label)) for label, p in sorted(PHRASES.items())]))
    df = df.withColumns({
        "first_word": F.when(some, words(F.get(parts, F.lit(0))).cast("long")),
        "last_word": F.when(some, F.col("n_words") - words(F.get(parts, F.size(parts) - 1)) - words(F.col("__l_last"))),
        "__l_base": base,
    })
    df = df.withColumns({
        "base_labels": F.array_join("__l_base", ","),
        "labels": F.array_join(F.sort_array(F.array_distinct(F.concat("__l_base", F.transform("detections", lambda x: x["label"])))), ","),
        "score": F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda x: x["confidence"])), F.lit(0.0)), F.when(some, 0.7).otherwise(0.0)),
    })
    return df.drop(*[c for c in df.columns if c.startswith("__l_")])


RESULT = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select(*RESULT, "detections")
