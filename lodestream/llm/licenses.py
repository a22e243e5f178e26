"""License scan: ordered signature rules over a text's words, with DataFrame functions alone.

A text is lower-cased over A-Z and read as words. Texts without any rule's gate word stop there. The others become one line of words;
each signature rule is a regular expression with a keyword that must occur before it is tried. A match that lies within another match
of a rule of higher priority, or of equal priority and greater length, is suppressed, so that "gnu lesser general public license" isn't
also a plain GPL mention. Base phrases are found word by word and are never suppressed.

Cases: a null or empty text has no words and no label, and null first and last words. Texts are read whole. Ties between equal matches of
one span keep every label. Repeated rows give equal results, extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Words of a text, before A-Z is lower-cased: the runs between other ASCII characters than digits and letters.
WORDS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Phrases whose words must stand consecutively, and their labels (fixed values).
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Families: label -> (keyword of the name, pattern of its name, pattern of its short identifier); over space-joined words. A blank after a label tells a second spelling (fixed values).
FAMILIES = {
    "mit": ("mit", "mit", "mit"),
    "apache": ("apache", "apache(?: software)?", "apache(?: \\d)*"),
    "gpl": ("general", "(?:gnu )?general public", "gpl(?:v?\\d)?(?: \\d)*(?: only| or later)?"),
    "lgpl": ("general public", "(?:gnu )?(?:lesser|library) general public", "lgpl(?:v?\\d)?(?: \\d)*(?: only| or later)?"),
    "agpl": ("affero", "(?:gnu )?affero general public", "agpl(?:v?\\d)?(?: \\d)*(?: only| or later)?"),
    "gfdl": ("documentation", "(?:gnu )?free documentation", "gfdl(?: \\d)*"),
    "bsd": ("bsd", "(?:(?:new|modified|simplified|revised|[0234] clause) )?bsd(?: [0234] clause)?", "bsd(?: [0234] clause)?"),
    "mpl": ("mozilla", "mozilla public", "mpl(?: \\d)*"),
    "epl": ("eclipse", "eclipse public", "epl(?: \\d)*"),
    "cddl": ("development", "common development and distribution", "cddl(?: \\d)*"),
    "cpl": ("common", "common public", "cpl(?: \\d)*"),
    "isc": ("isc", "isc", "isc"),
    "zlib": ("zlib", "zlib", "zlib"),
    "libpng": ("libpng", "libpng", "libpng(?: \\d)*"),
    "boost": ("boost", "boost software", "bsl \\d \\d"),
    "artistic": ("artistic", "artistic", "artistic(?: \\d)+"),
    "unlicense": ("unlicense", "unlicense", "unlicense"),
    "wtfpl": ("wtfpl", "wtfpl", "wtfpl"),
    "wtfpl ": ("want to public", "do what the fuck you want to public", "wtfpl"),
    "postgresql": ("postgresql", "postgresql", "postgresql"),
    "python": ("python", "python", "python(?: \\d)+"),
    "python ": ("python software", "python software foundation", "psf(?: \\d)*"),
    "php": ("php", "php", "php(?: \\d)+"),
    "ruby": ("ruby", "ruby", "ruby"),
    "openssl": ("openssl", "openssl", "openssl"),
    "ofl": ("font", "(?:sil )?open font", "ofl(?: \\d)*"),
    "eupl": ("european", "european union public", "eupl(?: \\d)*"),
    "ms-pl": ("microsoft", "microsoft public", "ms pl"),
    "ms-rl": ("reciprocal", "microsoft reciprocal", "ms rl"),
    "x11": ("x11", "x11", "x11"),
    "ncsa": ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa"),
    "w3c": ("w3c", "w3c(?: software)?", "w3c"),
    "zope": ("zope", "zope public", "zpl(?: \\d)*"),
    "afl": ("academic", "academic free", "afl(?: \\d)*"),
    "osl": ("open", "open software", "osl(?: \\d)*"),
    "qpl": ("public", "q public", "qpl(?: \\d)*"),
    "odbl": ("database", "(?:odc )?open database", "odbl(?: \\d)*"),
    "pddl": ("dedication", "public domain dedication and", "pddl(?: \\d)*"),
    "sspl": ("server", "server side public", "sspl(?: \\d)*"),
    "elastic": ("elastic", "elastic", "elastic(?: \\d)+"),
    "cc0": ("cc0", "cc0", "cc0(?: \\d)*"),
    "cc0 ": ("creative commons zero", "creative commons zero", "cc zero"),
    "cc-by": ("cc by", "cc by", "cc by(?: \\d)+"),
    "cc-by ": ("creative commons", "creative commons attribution", "creative commons by"),
    "cc-by-sa": ("cc by sa", "cc by sa", "cc by sa(?: \\d)+"),
    "cc-by-sa ": ("creative commons", "creative commons attribution share ?alike", "creative commons by sa"),
    "cc-by-nc": ("cc by nc", "cc by nc", "cc by nc(?: \\d)+"),
    "cc-by-nc ": ("creative commons", "creative commons attribution non ?commercial", "creative commons by nc"),
    "cc-by-nd": ("cc by nd", "cc by nd", "cc by nd(?: \\d)+"),
    "cc-by-nd ": ("creative commons", "creative commons attribution no ?deriv(?:ative)?s", "creative commons by nd"),
    "cc-by-nc-sa": ("cc by nc sa", "cc by nc sa", "cc by nc sa(?: \\d)+"),
    "cc-by-nc-sa ": ("creative commons", "creative commons attribution non ?commercial share ?alike", "creative commons by nc sa"),
    "cc-by-nc-nd": ("cc by nc nd", "cc by nc nd", "cc by nc nd(?: \\d)+"),
    "cc-by-nc-nd ": ("creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?s", "creative commons by nc nd"),
}
#: Signatures made for every family: (name, priority, strength, pattern with NAME or ID); the first stands first (fixed values).
TEMPLATES = (
    ("identifier", 50, 1.0, "spdx license identifier (?:ID)"),
    ("grant", 40, 0.95, "(?:licen[sc]ed|released|distributed|published|available|covered) (?:by|under|subject to) (?:a |the )?(?:terms (?:and conditions )?of (?:a |the )?)?(?:NAME)(?: licen[sc]e)?(?: (?:version|v) \\d| v?\\d)?(?: \\d)*"),
    ("short grant", 35, 0.9, "(?:licen[sc]ed|released|distributed|published|available|covered) (?:by|under|subject to) (?:a |the )?(?:ID)"),
    ("field", 30, 0.8, "licen[sc]es? (?:is |are )?(?:ID)"),
    ("name", 20, 0.6, "(?:NAME) licen[sc]e"),
)
#: Further signatures: (label, priority, strength, keyword, pattern) (fixed values).
OTHERS = (
    ("proprietary", 10, 0.5, "reserved", "all rights reserved"),
    ("public-domain", 10, 0.5, "domain", "(?:in|into|to) the public domain"),
    ("cc-url", 30, 0.8, "creativecommons", "creativecommons org licenses(?: [a-z]+)+(?: \\d)*"),
    ("warranty", 5, 0.3, "warrant", "without (?:any )?warrant(?:y|ies)(?: of any kind)?"),
    ("mit-text", 60, 1.0, "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd-text", 60, 1.0, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("isc-text", 60, 1.0, "permission", "permission to use copy modify and or distribute this software for any purpose"),
)
#: A text without any of these can't match a base phrase or a rule (fixed values).
GATES = ("licen", "released", "distributed", "published", "available", "covered", "reserved", "domain", "creativecommons", "warrant", "permission", "redistribution")


def _literal(pattern: str, otherwise: str) -> str:
    """The plain characters that every match of the pattern begins with; the family's keyword if the pattern has alternatives."""
    return otherwise if "|" in re.sub("\\(.*?\\)", "", pattern) else re.match("[a-z0-9 ]+", re.sub("[a-z0-9]\\?.*", "", pattern))[0].strip()


def rules() -> list[tuple[str, int, float, str, str]]:
    """All signatures: label, priority, strength, keyword, pattern."""
    made = [
        (label.strip(), priority, strength, keyword if "NAME" in pattern else _literal(short, keyword), pattern.replace("NAME", name).replace("ID", short))
        for _, priority, strength, pattern in TEMPLATES
        for label, (keyword, name, short) in FAMILIES.items()
    ]
    return made + [(label, priority, strength, keyword, pattern) for label, priority, strength, keyword, pattern in OTHERS]


def _first_words(pattern: str) -> str:
    return "(?<= )(?:" + pattern + ")(?= )"


def _rule_table() -> Column:
    return F.array(
        *(
            F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(strength).alias("strength"), F.lit(keyword).alias("keyword"), F.lit(_first_words(pattern)).alias("pattern"))
            for label, priority, strength, keyword, pattern in rules()
        )
    )


def _spans(line: str) -> Column:
    """Every match of every rule whose keyword occurs: label, priority, strength, from, to (characters of the line). A rule's matches and the text between them alternate, so lengths give the places; both are extracted once a rule."""
    return F.expr(f"""
        flatten(transform(
          transform(filter(rules, r -> contains({line}, r.keyword) AND rlike({line}, r.pattern)), r -> named_struct('r', r,
            'hits', transform(regexp_extract_all({line}, r.pattern, 0), h -> length(h)), 'gaps', transform(split({line}, r.pattern, -1), g -> length(g)))),
          x -> transform(
            aggregate(
              zip_with(slice(x.gaps, 1, size(x.hits)), x.hits, (g, h) -> named_struct('g', g, 'h', h)),
              named_struct('at', 0, 'found', CAST(array() AS ARRAY<STRUCT<a: INT, b: INT>>)),
              (acc, m) -> named_struct('at', acc.at + m.g + m.h, 'found', array_append(acc.found, named_struct('a', acc.at + m.g, 'b', acc.at + m.g + m.h))),
              acc -> acc.found),
            s -> named_struct('label', x.r.label, 'priority', x.r.priority, 'strength', x.r.strength, 'a', s.a, 'b', s.b))))
    """)


def _uncontained(spans: str, priorities: list[int]) -> Column:
    """The spans that lie in no span of higher priority, nor in a longer one of their own.

    In order of their beginning, the longer and higher first, whatever contains a span comes before it; so one pass suffices that keeps, for each priority from the highest
    down, the furthest end so far and the first beginning that reached it.
    """
    levels = ", ".join(f"named_struct('p', {p}, 'a', 0, 'b', -1)" for p in sorted(priorities, reverse=True))
    contained = "exists(acc.top, t -> (t.p > s.priority AND t.b >= s.b) OR (t.p = s.priority AND (t.b > s.b OR (t.b = s.b AND t.a < s.a))))"
    return F.expr(f"""
        aggregate(
          array_sort({spans}, (x, y) -> CASE WHEN x.a <> y.a THEN x.a - y.a WHEN x.b <> y.b THEN y.b - x.b ELSE y.priority - x.priority END),
          named_struct('top', array({levels}), 'kept', filter({spans}, s -> false)),
          (acc, s) -> named_struct(
            'top', transform(acc.top, t -> if(t.p = s.priority AND s.b > t.b, named_struct('p', t.p, 'a', s.a, 'b', s.b), t)),
            'kept', if({contained}, acc.kept, array_append(acc.kept, s))),
          acc -> acc.kept)""")


def _word_count(c: Column) -> Column:
    """Pieces between runs of separators, less the empty ones at the ends: cheaper than extracting the words."""
    edge = F.when(c.rlike(f"\\A{SEPARATOR}"), 1).otherwise(0) + F.when(c.rlike(f"{SEPARATOR}\\z"), 1).otherwise(0)
    return F.when(c == "", 0).otherwise(F.size(F.split(c, f"{SEPARATOR}+")) - edge)


def _base_places(words: str, phrases: dict[str, str]) -> Column:
    """Places of the phrases: at (number of the first word), label."""
    cases = []
    for label, phrase in phrases.items():
        own = phrase.split()
        tests = " AND ".join(f"get({words}, i - {len(own) - 1 - k}) = '{w}'" for k, w in enumerate(own[:-1])) or "true"
        cases.append(f"flatten(transform({words}, (w, i) -> if(w = '{own[-1]}' AND i >= {len(own) - 1} AND {tests}, array(named_struct('at', i - {len(own) - 1}, 'label', '{label}')), array())))")
    return F.expr(f"concat({', '.join([*cases, 'CAST(array() AS ARRAY<STRUCT<at: INT, label: STRING>>)'])})")


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    phrases = BASE if phrases is None else phrases
    whole = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    low = F.lower("text")
    gate = F.lit(False)
    for g in [*GATES, *{p.split()[-1] for p in phrases.values() if not any(g in p.split()[-1] for g in GATES)}]:
        gate = gate | F.contains(low, F.lit(g))
    seen = whole.select("doc_id", _word_count(F.col("text")).cast("long").alias("n_words"), F.when(gate, F.col("text")).alias("text"))
    none = F.lit(None)
    lined = seen.select("doc_id", "n_words", F.when(F.col("text").isNotNull(), F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORDS), F.lit(0))).alias("words"))
    lined = lined.select("doc_id", "n_words", "words", F.when(F.col("words").isNotNull(), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))).alias("line"), _rule_table().alias("rules"))
    found = lined.select("doc_id", "n_words", F.when(F.col("words").isNotNull(), _base_places("words", phrases)).alias("base"), F.when(F.col("line").isNotNull(), _spans("line")).alias("spans"))
    kept = _uncontained("spans", sorted({priority for _, priority, *_ in rules()}))
    out = found.select("doc_id", "n_words", "base", F.when(F.col("spans").isNotNull(), kept).alias("spans"))
    empty = F.array().cast("array<string>")
    base = F.coalesce(F.expr("transform(base, b -> b.label)"), empty)
    own = F.coalesce(F.expr("transform(spans, s -> s.label)"), empty)
    places = F.size(F.coalesce("base", F.array().cast("array<struct<at:int,label:string>>")))
    strength = F.coalesce(F.array_max(F.expr("transform(spans, s -> CAST(s.strength AS DOUBLE))")), F.lit(0.0))
    return out.select(
        "doc_id",
        "n_words",
        places.cast("long").alias("n_base"),
        F.when(places > 0, F.array_min(F.expr("transform(base, b -> b.at)"))).otherwise(none).cast("long").alias("first_word"),
        F.when(places > 0, F.array_max(F.expr("transform(base, b -> b.at)"))).otherwise(none).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.greatest(strength, F.when(places > 0, F.lit(0.6)).otherwise(F.lit(0.0))).alias("score"),
    )
