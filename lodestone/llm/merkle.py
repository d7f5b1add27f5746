"""Operator 13: a Merkle manifest of a dataset, with octopus multiproofs.

Every row is a leaf. The leaves of a group (here: a source) are ordered and hashed in runs of ``ARITY``
up to one subroot; the subroots, in the order of their groups, are the leaves of one more tree, whose
top is the root.

1. Leaves are dealt by range of (group, order) into partitions of about ``leaves`` rows, so a group that
   holds a third of all rows is many partitions. Counts of (partition, group) give every leaf its place.
2. A partition hashes what it can: each run of which it knows all nodes becomes a node of the next level.
   Nodes of runs that reach beyond are left open. Open nodes of ``FAN`` neighbouring partitions meet in one
   task, which goes on in the same way, until one task holds the tops. At most four nodes of each level
   and partition are open, so no task holds more than follows from ``FAN``.
3. Octopus: a partition goes up from its own leaves and lists the coordinates of the nodes that its runs
   lack, each once, however many of its leaves need it. The list is joined with the open nodes once.
4. With what it fetched the partition derives all interior nodes above its leaves, once, and reads every
   leaf's own proof off them. Proofs of subroots come in the same way from the tree of subroots.

Nulls are part of a leaf (``-``); a null group is the first one. Rows of one id are ordered by their
digest, and equal rows are neighbours, whichever comes first. A null id comes first in its group. Very long
texts are hashed whole. An empty table gives no rows. Extra columns take part only if they are named.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small_ids, materialize, numbered, ship_code

ARITY = 3
FAN = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
Level = dict[int, bytes]


def digest(parts: Iterable[bytes]) -> bytes:
    """SHA-256 of digests joined as hex text, as hex text."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def leaf_digest(fields: Iterable[Column]) -> Column:
    """SHA-256 (binary) of the fields, each with its byte count before it; null is a dash."""

    def part(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*(part(c) for c in fields)), 256))


def group_key(c: Column) -> Column:
    """A group as text that orders null first and other values bytewise."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def run_of(at: int, size: int) -> range:
    """The places of a run in a level of ``size`` nodes."""
    return range(ARITY * at, min(ARITY * at + ARITY, size))


def missing(places: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """(level, place) of the nodes that the leaves at ``places`` lack to reach the top: for each level the
    others of the runs that hold a known node."""
    at, level = np.unique(places), 0
    while size > 1:
        runs = np.unique(at // ARITY)
        whole = (ARITY * runs[:, None] + np.arange(ARITY)).ravel()
        for place in np.setdiff1d(whole[whole < size], at):
            yield level, int(place)
        at, size, level = runs, -(-size // ARITY), level + 1


def derive(levels: defaultdict[int, Level], size: int) -> tuple[set[tuple[int, int]], bytes | None]:
    """Add the nodes whose whole run is known, level by level. Gives the coordinates of the nodes whose run
    is not whole, and the top if it is known."""
    left, level = set(), 0
    while size > 1:
        known = levels[level]
        for run in sorted({at // ARITY for at in known}):
            places = run_of(run, size)
            if all(at in known for at in places):
                levels[level + 1].setdefault(run, digest(known[at] for at in places))
            else:
                left.update((level, at) for at in places if at in known)
        size, level = -(-size // ARITY), level + 1
    return left, levels[level].get(0)


def proof(levels: dict[int, Level], at: int, size: int) -> list[tuple[int, list[bytes]]]:
    """For each level the place within the run and the run's other nodes."""
    steps, level = [], 0
    while size > 1:
        places = run_of(at // ARITY, size)
        steps.append((at % ARITY, [levels[level][x] for x in places if x != at]))
        at, size, level = at // ARITY, -(-size // ARITY), level + 1
    return steps


def fold(node: bytes, steps: Iterable[tuple[int, list[bytes]]]) -> bytes:
    """The root that a leaf and its proof lead to."""
    for place, others in steps:
        node = digest([*others[:place], node, *others[place:]])
    return node


def pack(steps: Iterable[tuple[int, list[bytes]]]) -> bytes:
    """A proof as bytes: for each level place, number of nodes, nodes (32 bytes each)."""
    return b"".join(bytes([place, len(others)]) + bytes.fromhex(b"".join(others).decode()) for place, others in steps)


def unpack(packed: bytes) -> list[tuple[int, list[bytes]]]:
    steps, i = [], 0
    while i < len(packed):
        place, n = packed[i], packed[i + 1]
        body = packed[i + 2 : i + 2 + 32 * n].hex().encode()
        steps.append((place, [body[64 * j : 64 * j + 64] for j in range(n)]))
        i += 2 + 32 * n
    return steps


@dataclass
class Part:
    """What one task holds of one leaf partition: for each group its size and known nodes."""

    sizes: dict[str, int] = field(default_factory=dict)
    levels: dict[str, defaultdict[int, Level]] = field(default_factory=lambda: defaultdict(lambda: defaultdict(dict)))

    def add(self, group: str, size: int, level: int, at: int, node: bytes) -> None:
        self.sizes[group] = size
        self.levels[group][level][at] = node


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each partition number; rows are sorted by ``part``."""
    part, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["part"] != part and rows:
                yield part, rows
                rows = []
            part = row["part"]
            rows.append(row)
    if rows:
        yield part, rows


TOP = -1
_NODE = "part long, grp string, size long, level int, at long, node binary, open boolean"
_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[{"long": "bigint"}.get(kind, kind)]) for name, kind in (x.split() for x in ddl.split(", "))])


def _batches(rows: list[tuple], schema: pa.Schema, most: int = 5_000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), most):
        columns = zip(*rows[i : i + most], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def climb(first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Derive the nodes of each partition. The first time this gives the open ones and, without a node, the
    coordinates that the partition's leaves lack (a whole run is of no use to others then); later, all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(_NODE)
        for part, rows in runs_of(batches):
            held, out = Part(), []
            for r in rows:
                held.add(r["grp"], r["size"], r["level"], r["at"], r["node"].hex().encode())
            for group, levels in held.levels.items():
                size = held.sizes[group]
                if first:
                    out += [(part, group, size, *at, None, False) for at in missing(np.fromiter(levels[0], np.int64), size)]
                left, top = derive(levels, size)
                given = left if first else [(level, at) for level, known in levels.items() for at in known]
                out += [(part // FAN, group, size, *x, bytes.fromhex(levels[x[0]][x[1]].decode()), x in left) for x in given]
                if top is not None:
                    out.append((part // FAN, group, size, TOP, 0, bytes.fromhex(top.decode()), False))
            yield from _batches(out, schema)

    return run


@dataclass(frozen=True)
class Tree:
    """Leaves (part, grp, size, at, node and the users' columns), the (part, grp) there are, the coordinates
    that partitions lack, the nodes that others may lack, and the tops (grp, top)."""

    parts: int
    leaves: DataFrame
    spans: DataFrame
    lacking: DataFrame
    nodes: DataFrame
    tops: DataFrame


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "part").sortWithinPartitions("part")


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the rows of each group (first column) within a partition; they are sorted by it."""
    last, seen = None, 0
    for batch in batches:
        groups = batch.column(0).dictionary_encode()
        code = groups.indices.to_numpy(zero_copy_only=False)
        if not len(code):
            continue
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        within = np.arange(len(code)) - np.repeat(first, np.diff(np.r_[first, len(code)]))
        if groups.dictionary[int(code[0])].as_py() == last:
            within[: first[1] if len(first) > 1 else len(code)] += seen
        last, seen = groups.dictionary[int(code[-1])].as_py(), int(within[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(within, pa.int64())], names=[*batch.schema.names, "within"])


def build(leaves: DataFrame, order: list[str], per_part: int, name: str) -> Tree:
    """The trees of all groups. ``leaves`` is a stored table of grp, node (binary) and further columns, in
    ``order`` within a group."""
    spark = leaves.sparkSession
    n = leaves.count()
    parts = max(-(-n // per_part), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 1000)), 1)
    columns = ["grp", *(c for c in leaves.columns if c != "grp")]
    ranged = leaves.select(*columns).repartitionByRange(parts, "grp", *order).sortWithinPartitions("grp", *order)
    ddl = ", ".join(f"{c} {leaves.schema[c].dataType.simpleString()}" for c in columns)
    placed = materialize(ranged.mapInArrow(_places, f"{ddl}, within long").withColumn("part", F.spark_partition_id().cast("long")), f"{name}-placed")
    counts = placed.groupBy("part", "grp").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = materialize(counts.select("part", "grp", F.coalesce(before, F.lit(0)).alias("first"), F.sum("n").over(group).alias("size")), f"{name}-spans")
    # as many partitions as there are, whatever was asked for
    held = spans.agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("last")).first()
    others = [c for c in columns if c not in ("grp", "node")]
    full = join_small_ids(placed, spans, held["n"], ["part", "grp"]).select("part", "grp", "size", (F.col("first") + F.col("within")).alias("at"), "node", *others)
    climbed = materialize(_dealt(full.select("part", "grp", "size", F.lit(0).alias("level"), "at", "node"), parts).mapInArrow(climb(True), _NODE), f"{name}-open")
    lacking, nodes = climbed.where("node is null").select("part", "grp", "level", "at"), climbed.where("node is not null")
    left, above = nodes, (held["last"] or 0) + 1
    while above > 1:
        above = -(-above // FAN)
        left = materialize(_dealt(left.where("open").drop("open"), above).mapInArrow(climb(False), _NODE), f"{name}-open")
        nodes = nodes.unionAll(left)
    return Tree(parts, full, spans, lacking, nodes.where(f"level > {TOP}").select("grp", "level", "at", "node"), nodes.where(f"level = {TOP}").select("grp", F.col("node").alias("top")))


def prove(tree: Tree, columns: list[str], tails: DataFrame | None = None) -> DataFrame:
    """``columns`` of the leaves, node, top (of the group) and path, the packed proof of each leaf. With ``tails``
    (grp, tail) a path goes on with its group's tail."""
    fetched = tree.lacking.join(tree.nodes, ["grp", "level", "at"]).select("part", "grp", F.lit(None).cast("long").alias("size"), "level", "at", "node")
    if tails is not None:
        ends = tree.spans.select("part", "grp").join(tails, "grp")
        fetched = fetched.unionAll(ends.select("part", "grp", F.lit(None).cast("long"), F.lit(TOP), F.lit(0).cast("long"), "tail"))
    kinds = {c: tree.leaves.schema[c].dataType.simpleString() for c in columns}
    fetched = fetched.select("*", *(F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()))
    leaves = tree.leaves.select("part", "grp", "size", F.lit(0).alias("level"), "at", "node", *columns)
    ddl = ", ".join([*(f"{c} {kind}" for c, kind in kinds.items()), "grp string, node binary, top binary, path binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema(ddl)
        for _, rows in runs_of(batches):
            held, tail, own = Part(), {}, []
            for r in rows:
                if r["level"] == TOP:
                    tail[r["grp"]] = r["node"]
                    continue
                held.levels[r["grp"]][r["level"]][r["at"]] = r["node"].hex().encode()
                if r["size"] is not None:  # else it was fetched
                    held.sizes[r["grp"]] = r["size"]
                    own.append(r)
            tops = {}
            for group, levels in held.levels.items():
                tops[group] = bytes.fromhex(derive(levels, held.sizes[group])[1].decode())
            for i in range(0, len(own), 5_000):
                out = []
                for r in own[i : i + 5_000]:
                    group = r["grp"]
                    path = pack(proof(held.levels[group], r["at"], held.sizes[group])) + tail.get(group, b"")
                    out.append((*(r[c] for c in columns), group, r["node"], tops[group], path))
                yield from _batches(out, schema)

    return _dealt(leaves.unionAll(fetched), tree.parts).mapInArrow(run, ddl)


def manifest(docs: DataFrame, group: str = "source", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, offered: Column | None = None, leaves: int = 50_000) -> DataFrame:
    """``order`` (long), leaf, subroot, root (hex) and path (the packed proof from leaf to root) of every row,
    and ``offered``, a digest computed in the same scan, where it is given.

    ``leaves`` bounds the rows of a partition, so what a task holds. Rows are told apart by a number, so equal
    rows may be any share of the table.
    """
    ship_code(docs.sparkSession)
    names = {f: F.col(f"field{i}") for i, f in enumerate(fields)}
    rows = docs.select(F.col(group).alias("group_"), F.col(order).cast("long").alias("order_"), *(F.col(f"`{f}`").alias(f"field{i}") for i, f in enumerate(fields)), *([] if offered is None else [offered.alias("offered_")]))
    found = numbered(rows, "op13-rows")
    extra = [] if offered is None else ["offered_"]
    thin = materialize(found.select(group_key(F.col("group_")).alias("grp"), "order_", leaf_digest(names.values()).alias("node"), *extra, "row"), "op13-rows")
    tree = build(thin, ["order_", "node", "row"], leaves, "op13")
    subroots = materialize(tree.tops.select(F.lit("").alias("grp"), F.col("top").alias("node"), F.col("grp").alias("member")), "op13-subroots")
    above = build(subroots, ["member"], leaves, "op13-above")
    root = above.tops.first()
    tails = prove(above, ["member"]).select(F.col("member").alias("grp"), F.col("path").alias("tail"))
    hexed = lambda c: F.lower(F.hex(c))
    proved = prove(tree, ["order_", *extra], tails)
    return proved.select(
        F.col("order_").alias(order), hexed("node").alias("leaf"), hexed("top").alias("subroot"), F.lit(None if root is None else root["top"].hex()).alias("root"), "path", *(hexed(c).alias("offered") for c in extra)
    )


def audit(proved: DataFrame, leaf: str = "leaf") -> DataFrame:
    """``proved`` with proof_sha256 (digest of a proof's nodes, from the leaf up), folded_root (what the digest in
    column ``leaf`` and the proof lead to) and verified (whether that is the root)."""
    kept = proved.drop("proof_sha256", "folded_root", "verified", "path")
    ddl = ", ".join([*(f"{c} {kept.schema[c].dataType.simpleString()}" for c in kept.columns), "proof_sha256 string, folded_root string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            proofs, roots = [], []
            for node, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                steps = unpack(packed)
                proofs.append(digest(x for _, others in steps for x in others).decode())
                roots.append(fold(node.encode(), steps).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(proofs, pa.string()), pa.array(roots, pa.string())], names=[*batch.schema.names[2:], "proof_sha256", "folded_root"])

    checked = proved.select(F.col(leaf).alias("leaf_"), "path", *kept.columns).mapInArrow(run, ddl)
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def without_newlines(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> Column:
    """The digest that a row's leaf would have with the newlines of its text gone, for rows whose id has an
    even crc32; of the others their own."""
    own = [F.col(f) for f in fields]
    changed = [F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in fields]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, leaf_digest(changed)).otherwise(leaf_digest(own))


def oracle(levels: int = 14, above: int = 8) -> str:
    """DuckDB SQL for the rows of the query, for sources of at most ``ARITY ** levels`` rows."""
    part = lambda c: f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')"
    leaf = lambda text: "sha256(" + " || ".join(part(text if c == "text" else c) for c in FIELDS) + ")"
    steps = f"""
with recursive crc(c, byte) as (select i, i from range(256) x(i)), bits as (
  select byte, list_reduce(list_prepend(c::bigint, range(8)::bigint[]), lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) c from crc),
codes as (select list(c order by byte) codes from bits),
d as (select *, doc_id::varchar t, row_number() over () n from documents),
e as (select d.*, coalesce(xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(t) + 1), lambda i: ascii(t[i])::bigint)), lambda a, b: xor(a >> 8, codes[xor(a & 255, b) + 1])), 4294967295) % 2 = 0, false) forged from d, codes),
a0 as materialized (select n, doc_id, coalesce('=' || source, '') g, {leaf('text')} h, case when forged then {leaf("replace(text, chr(10), '')")} else {leaf('text')} end o from e),
l0 as materialized (select n, doc_id, g, h, o, row_number() over (partition by g order by doc_id nulls first, h, n) - 1 i from a0),
p0 as materialized (select n, g, i, '' proof, o fold from l0),
t0 as materialized (select g, i, h from l0)"""

    def level(k: int) -> str:
        return f""",
s{k} as materialized (select *, count(*) over (partition by g) m from t{k}),
r{k} as materialized (select g, i // 3 i, case when any_value(m) > 1 then sha256(string_agg(h, '' order by i)) else any_value(h) end h, list(h order by i) hs, any_value(m) m from s{k} group by g, i // 3),
p{k + 1} as materialized (select n, p.g, p.i // 3 i, case when m > 1 then proof || coalesce(array_to_string(hs[:p.i % 3] || hs[p.i % 3 + 2:], ''), '') else proof end proof,
  case when m > 1 then sha256(coalesce(array_to_string(hs[:p.i % 3], ''), '') || fold || coalesce(array_to_string(hs[p.i % 3 + 2:], ''), '')) else fold end fold
  from p{k} p join r{k} r on p.g = r.g and p.i // 3 = r.i),
t{k + 1} as materialized (select g, i, h from r{k})"""

    text = steps + "".join(level(k) for k in range(levels))
    text += f""",
subs as materialized (select g source, h subroot, row_number() over (order by encode(g)) - 1 place from t{levels}),
t{levels + 1} as materialized (select '' g, place i, subroot h from subs),
p{levels + 1} as materialized (select n, '' g, place i, proof, fold from p{levels} p join subs on p.g = subs.source)"""
    text += "".join(level(k) for k in range(levels + 1, levels + 1 + above))
    last = levels + 1 + above
    return f"""{text}
select doc_id, l0.h leaf, subroot, t.h root, sha256(proof) proof_sha256, fold folded_root, fold = t.h verified
from l0 join p{last} p using (n) join subs on subs.source = l0.g join t{last} t on true"""
