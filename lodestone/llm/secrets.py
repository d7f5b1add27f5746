"""Operator 8: secret scan.

Per text: one Aho-Corasick pass over the ASCII-lowered text finds keywords; regular expressions are
tried only where a keyword begins, anchored there; candidates of token formats that embed a
checksum are then validated by it. Runs of hexadecimal digits have no keyword: they are found from
every 32nd character, which a run of 32 must cover.

Kinds: ``assign``, ``access`` and ``hex`` are the base kinds; ``crc_token`` (prefix, 30 base-62
characters, then the six base-62 digits of their CRC-32) is the method's addition. Positions are
code points, end exclusive. Null texts are empty. Texts of any length are scanned whole, one row at
a time. Spans that begin together are listed by kind, in the order above. Repeated rows are answered row
by row; an empty table gives no rows; other columns, of whatever name, pass unread.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_code

KINDS = ("assign", "access", "hex", "crc_token")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
CRC_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CRC_TOKEN = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX_RUN = 32
SCHEMA = "doc_id long, kinds array<string>, starts array<int>, ends array<int>"

_automaton: list = []


def keyword_automaton():
    if not _automaton:
        a = ahocorasick.Automaton()
        for kind, words in (("assign", ASSIGN_WORDS), ("access", ("akia",)), ("crc_token", CRC_PREFIXES)):
            for w in words:
                a.add_word(w, (kind, len(w)))
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


def crc_digits(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0")


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of at least 32 hexadecimal digits."""
    done = 0
    for i, c in enumerate(text[HEX_RUN - 1 :: HEX_RUN]):
        if c in "0123456789abcdef":
            at = HEX_RUN - 1 + i * HEX_RUN
            if at < done:
                continue
            lo = at
            while lo > done and text[lo - 1] in "0123456789abcdef":
                lo -= 1
            done = HEX.match(text, at).end()
            if done - lo >= HEX_RUN:
                yield lo, done


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of every secret, in order."""
    raw = text.encode()
    lowered = raw.lower().decode()
    found = []
    free = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in keyword_automaton().iter(lowered):
        at = last - length + 1
        if at < free[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                free[kind] = m.end()
                if len(m[2]) >= 8:
                    found.append((at, 0, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                free[kind] = m.end()
                if m.end() - at >= 16:
                    found.append((at, 1, m.end()))
        elif (m := CRC_TOKEN.match(text, at)) and crc_digits(m[1]) == m[2]:
            free[kind] = m.end()
            found.append((at, 3, m.end()))
    found += [(a, 2, b) for a, b in hex_runs(text)]
    return sorted(found)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of its secrets: kinds, starts, ends (see SCHEMA), ordered by start."""
    ship_code(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [scan(t) if t else [] for t in (x.as_py() for x in b.column(1))]
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array([[KINDS[k] for _, k, _ in s] for s in spans], pa.list_(pa.string())),
                    pa.array([[a for a, _, _ in s] for s in spans], pa.list_(pa.int32())),
                    pa.array([[e for _, _, e in s] for s in spans], pa.list_(pa.int32())),
                ],
                names=["doc_id", "kinds", "starts", "ends"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def summarize(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of :func:`find_secrets`."""
    items = F.arrays_zip("kinds", "starts", "ends")
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kinds"], x["starts"].cast("string"), x["ends"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(shown(F.filter(items, lambda x: x["kinds"].isin(*KINDS[:3]))), 256).alias("base_sha256"),
        shown(items).alias("spans"),
    )


def mask_text(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with every secret replaced; overlapping spans become one mask."""
    if not text:
        return text
    out, done = [], 0
    for a, _, b in scan(text):
        if a >= done:
            out += [text[done:a], mask]
        done = max(done, b)
    return "".join(out) + text[done:] if out else text


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The same rows and columns with secrets masked in ``text``; ``n_chars`` follows it."""
    ship_code(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([mask_text(x.as_py()) for x in b.column(at)], b.schema.field(at).type))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may hold dots
    masked = plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked


def base_digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < 3).encode()).hexdigest()
