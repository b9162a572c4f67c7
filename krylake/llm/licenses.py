"""License scans: ordered signature rules behind a keyword prefilter.

A rule is a regex over a document's words joined by single spaces, so that punctuation, line breaks
and comment signs don't matter. Rules are tried only where one of their keywords occurs. Detections
that lie within one of a rule that comes earlier are suppressed.
"""

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from krylake.llm.common import batch, lowered, table
from krylake.llm.license_rules import TEXTS

#: What parts words once A-Z are lower-cased: all ASCII but digits and a-z.
SEPARATORS = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A))
TO_SPACE = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))

#: The phrases that count as base detections.
BASE = (("mit", b"under the mit license"), ("apache-2", b"apache license version 2"), ("cc-by-nc", b"cc by nc"))

#: Families: label, names as regexes over words, versions (regex, suffix of the label).
FAMILIES = (
    ("mit", ("mit", "expat"), ()),
    ("apache", ("apache software", "apache"), (("1 0", "1"), ("1 1", "1.1"), ("2(?: 0)?", "2"))),
    ("gpl", ("gnu general public", "gnu gpl", "gpl"), (("1(?: 0)?", "1"), ("2(?: 0)?", "2"), ("3(?: 0)?", "3"))),
    ("lgpl", ("gnu (?:lesser|library) general public", "gnu lgpl", "lgpl"), (("2(?: 0)?", "2"), ("2 1", "2.1"), ("3(?: 0)?", "3"))),
    ("agpl", ("gnu affero general public", "affero general public", "agpl"), (("1(?: 0)?", "1"), ("3(?: 0)?", "3"))),
    ("gfdl", ("gnu free documentation", "gfdl"), (("1 1", "1.1"), ("1 2", "1.2"), ("1 3", "1.3"))),
    ("mpl", ("mozilla public", "mpl"), (("1 0", "1"), ("1 1", "1.1"), ("2(?: 0)?", "2"))),
    ("epl", ("eclipse public", "epl"), (("1(?: 0)?", "1"), ("2(?: 0)?", "2"))),
    ("eupl", ("european union public", "eupl"), (("1 0", "1"), ("1 1", "1.1"), ("1 2", "1.2"))),
    ("cddl", ("common development and distribution", "cddl"), (("1 0", "1"), ("1 1", "1.1"))),
    ("cpl", ("common public",), (("1(?: 0)?", "1"),)),
    ("bsd", ("bsd", "berkeley software distribution"), (("2 clause", "2-clause"), ("3 clause", "3-clause"), ("4 clause", "4-clause"), ("0 clause", "0-clause"))),
    ("isc", ("isc", "internet systems consortium"), ()),
    ("zlib", ("zlib(?: libpng)?",), ()),
    ("artistic", ("artistic",), (("1 0", "1"), ("2(?: 0)?", "2"))),
    ("boost", ("boost software", "bsl"), (("1 0", "1"),)),
    ("unlicense", ("unlicense",), ()),
    ("wtfpl", ("do what the fuck you want to public", "wtfpl"), (("2(?: 0)?", "2"),)),
    ("psf", ("python software foundation", "psf"), (("2(?: 0)?", "2"),)),
    ("openssl", ("openssl",), ()),
    ("ofl", ("sil open font", "open font", "ofl"), (("1 0", "1"), ("1 1", "1.1"))),
    ("afl", ("academic free", "afl"), (("2 1", "2.1"), ("3(?: 0)?", "3"))),
    ("osl", ("open software", "osl"), (("2 1", "2.1"), ("3(?: 0)?", "3"))),
    ("ms-pl", ("microsoft public", "ms pl"), ()),
    ("ms-rl", ("microsoft reciprocal", "ms rl"), ()),
    ("ncsa", ("university of illinois ncsa open source", "ncsa open source"), ()),
    ("odbl", ("open database", "odbl"), (("1 0", "1"),)),
    ("pddl", ("public domain dedication and", "pddl"), (("1 0", "1"),)),
    ("postgresql", ("postgresql",), ()),
    ("upl", ("universal permissive", "upl"), (("1 0", "1"),)),
    ("bigscience-rail", ("bigscience (?:open )?rail(?: m)?", "open rail m"), ()),
    ("llama", ("llama (?:[0-9] )?community",), ()),
)

#: Creative Commons: the parts' names, short and long, and the versions.
CC_PARTS = (("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s?"), ("by-nc-sa", "attribution non ?commercial share ?alike"), ("by-nc", "attribution non ?commercial"), ("by-nd", "attribution no ?deriv(?:ative)?s?"), ("by-sa", "attribution share ?alike"), ("by", "attribution"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0", "")

@functools.cache
def rules() -> tuple[tuple[int, str, str, float], ...]:
    """(priority, label, regex over words, weight), the most telling first: whole sentences, named versions, names, tags."""
    out = [(label, rx, key, 1.0) for label, rx, key in TEXTS]
    lead = "(?:(?:licensed |released |distributed |available |published |provided )?under (?:the )?(?:terms of (?:the )?)?)?"
    for part, long in CC_PARTS:
        for v in CC_VERSIONS:
            tail, name = (f" {v}", f"cc-{part}-{v.replace(' ', '.')}") if v else ("", f"cc-{part}")
            out += [(name, f"creative commons {long}{tail}(?: (?:international|unported|generic))?(?: public)?(?: licen[sc]e)?", "creative", 0.9 if v else 0.8)]
            out += [(name, f"cc {part.replace('-', ' ')}{tail}", "cc", 0.9 if v else 0.7)]
    for label, names, versions in FAMILIES:
        for name in names:
            key = max(re.sub(r"\(.*?\)\??|\?", " ", name).split(), key=len)
            for v, suffix in versions:
                full = f"{label}-{suffix}"
                out += [(full, f"{lead}{name} licen[sc]e(?: as published by the free software foundation)?(?: either)? (?:version |v ?)?{v}", key, 0.95)]
                out += [(full, f"{name} (?:version |v ?)?{v}(?: licen[sc]e)?", key, 0.8)] if name != "apache" or suffix == "2" else []
            out += [(label, f"(?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?{name} licen[sc]e", key, 0.9)]
            out += [(label, f"under the {name} licen[sc]e", key, 0.85), (label, f"{name} licen[sc]e", key, 0.7)]
            out += [(label, f"(?:spdx )?license identifier {name}(?: [0-9]+)*(?: (?:only|or later|clause))?", key, 0.95)]
    order = sorted(enumerate(out), key=lambda x: (-x[1][3], x[0]))
    return tuple((i, label, rx, key, weight) for i, (_, (label, rx, key, weight)) in enumerate(order))


@functools.cache
def gate() -> dict[bytes, tuple]:
    """The compiled rules of each keyword; a rule applies only to texts with one of its keywords among their words."""
    by_key: dict[bytes, list] = {}
    for priority, label, rx, key, weight in rules():
        compiled = re.compile(rb"(?<= )" + rx.encode() + rb"(?= )")
        for k in key.split("|"):
            by_key.setdefault(k.encode(), []).append((priority, label, compiled, weight))
    return {k: tuple(v) for k, v in by_key.items()}


def detections(plain: bytes, words: list[bytes]) -> list[tuple[int, int, str, float]]:
    """(start, end, label, weight) over ` word word ... `, without those within a detection of an earlier rule.

    Rules are taken in the order of their priority. The kept detections are held by their starts with the furthest
    end so far, so that one lookup tells whether one of them holds another: n log n in the detections of a text.
    """
    by_key = gate()
    due = {rule[0]: rule for k in by_key.keys() & set(words) for rule in by_key[k]}
    starts, reach = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends, kept = starts, []
    for _, label, rx, weight in (due[p] for p in sorted(due)):
        at = np.array([m.span() for m in rx.finditer(plain)], np.int64).reshape(-1, 2)
        if not len(at):
            continue
        if len(starts):
            before = np.searchsorted(starts, at[:, 0], "right") - 1
            at = at[(before < 0) | (reach[np.maximum(before, 0)] < at[:, 1])]
        kept += [(a, b, label, weight) for a, b in at.tolist()]
        order = np.argsort(np.append(starts, at[:, 0]), kind="stable")
        starts, ends = np.append(starts, at[:, 0])[order], np.append(ends, at[:, 1])[order]
        reach = np.maximum.accumulate(ends)
    return kept


def places(plain: bytes, phrase: bytes) -> list[int]:
    """Where ` phrase ` stands in the text; it may share its last space with the next."""
    out, at = [], plain.find(phrase)
    while at >= 0:
        out.append(at)
        at = plain.find(phrase, at + 1)
    return out


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score and the spans (first word, words, label)."""
    words = lowered(text).translate(TO_SPACE).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0, []
    plain = b" " + b" ".join(words) + b" "
    base = {label: places(plain, b" " + phrase + b" ") for label, phrase in BASE}
    base = {label: at for label, at in base.items() if at}
    found = detections(plain, words)
    labels = base.keys() | {x[2] for x in found}
    first = last = None
    spans: list[tuple[int, int, str]] = []
    if base or found:
        spaces = np.flatnonzero(np.frombuffer(plain, np.uint8) == 0x20)
        word = lambda at: np.searchsorted(spaces, at).tolist()  # noqa: E731  the number of the word after the space at `at`
        hits = word(np.array([a for at in base.values() for a in at], np.int64))
        first, last = (min(hits), max(hits)) if hits else (None, None)
        begin, end = word(np.array([x[0] - 1 for x in found], np.int64)), word(np.array([x[1] for x in found], np.int64))
        spans = sorted((b, e - b, x[2]) for b, e, x in zip(begin, end, found, strict=True))
    score = max([0.85 * bool(base), *(x[3] for x in found)])
    return len(words), sum(map(len, base.values())), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, spans


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("label", pa.string())])))])
DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: long, words: long, label: string>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text; other columns are ignored), with detections as spans of words.

    Null and empty texts have no words and no labels, score 0. score: the weight of the strongest
    detection, 0.85 for a base phrase. Rows that repeat each get a row. Texts are scanned whole, in time
    n log n of their detections. No rows give none.
    """

    def run(batches):
        for b in batches:
            rows = [scan(t) for t in b.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            spans = [[{"start": s, "words": n, "label": x} for s, n, x in row] for row in columns[7]]
            yield batch(SCHEMA, b.column(0), *columns[:7], spans)

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(run, DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
