"""Sharding by a hierarchical weighted hash tree.

A key descends from the root through region, rack and shard. At each node every child draws
``ln(u) / weight`` with ``u`` from a hash of the key and the child's path; the greatest draw wins. A
child's draw depends on nothing but the key, its path and its weight, so a changed weight moves rows
only into (or out of) the child whose weight changed. An inner node weighs the sum of its shards,
unless ``inner`` fixes its weight; with fixed weights above it, a change below stays in its subtree.

A new shard in a region of its own adds weight to that region alone: it takes its share of rows from
all others and none of them gains a row.

All of it is column expressions; nothing is shuffled but narrow rows for the gapless slots.

Defined results: a null key counts as an empty one. A null text has size 1 and a null checksum. Rows
equal in key, size and checksum are interchangeable: they share a shard and take consecutive slots.
An empty table gives no rows. Columns other than those named are not read by ``shard_slots``; equal
names do not matter to ``shard_of``, which is an expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

_DIGITS = 13  # hexadecimal digits of a draw: 52 bits are exact in a double
SLOT_PARTS = 1 << 18  # parts of shards in which slots are counted: 16, 256 or 4096 of each shard


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0

    @property
    def path(self) -> tuple[str, str, str]:
        return self.region, self.rack, str(self.shard)


def default_tree(shards: int = 8) -> tuple[Leaf, ...]:
    """The first 8 shards in 2 regions of 2 racks of 2; each further one in a region of its own."""
    first = [Leaf(f"r{s // 4}", f"k{s // 2 % 2}", s) for s in range(min(shards, 8))]
    return (*first, *(Leaf(f"r{s - 6}", "k0", s) for s in range(8, shards)))


def _grown(tree: tuple[Leaf, ...], shards: int) -> tuple[Leaf, ...]:
    """The tree with one shard more, in a region of its own."""
    return (*tree, Leaf(f"new{shards}", "k0", shards)) if tree != default_tree(shards) else default_tree(shards + 1)


def _children(tree: tuple[Leaf, ...], above: tuple[str, ...], inner: dict[tuple[str, ...], float]) -> dict[tuple[str, ...], float]:
    weights: dict[tuple[str, ...], float] = {}
    for leaf in tree:
        if leaf.weight > 0 and leaf.path[: len(above)] == above:
            child = leaf.path[: len(above) + 1]
            weights[child] = weights.get(child, 0.0) + leaf.weight
    return {child: inner.get(child, weight) for child, weight in weights.items() if inner.get(child, weight) > 0}


def _draw(key: Column, path: tuple[str, ...], weight: float) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(":" + "/".join(path)))), 1, _DIGITS)
    u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**_DIGITS))
    return F.ln(u) / F.lit(float(weight))


def shard_of(key: Column, tree: tuple[Leaf, ...], inner: dict[tuple[str, ...], float] | None = None) -> Column:
    """The shard of a key, as an expression."""
    if not any(leaf.weight > 0 for leaf in tree):
        raise ValueError("a tree needs a shard with a positive weight")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def below(above: tuple[str, ...]) -> Column:
        if len(above) == 3:
            return F.lit(int(above[-1]))
        children = _children(tree, above, inner or {})
        if len(children) == 1:
            return below(next(iter(children)))
        drawn = [(_draw(text, c, w), below(c)) for c, w in children.items()]
        choice = drawn[-1][1]
        for i in range(len(drawn) - 2, -1, -1):
            others = [d for d, _ in drawn[i + 1 :]]
            best = F.greatest(*others) if len(others) > 1 else others[0]
            choice = F.when(drawn[i][0] >= best, drawn[i][1]).otherwise(choice)
        return choice

    return below(()).cast("int")


def shard_slots(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 8, tree: tuple[Leaf, ...] | None = None,
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard after one more is added.

    Slots count from 0 in each shard, in order of a hash of the key. Up to 4096 parts of a shard are
    counted first, so no window holds more than such a part; repeated rows meet as one row with a count.
    """
    tree = tree or default_tree(shards)
    digits = next((d for d in (3, 2) if len(tree) * 16**d <= SLOT_PARTS), 1)
    grown = _grown(tree, shards)
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    order = F.md5(F.concat(F.lit("slot:"), name))
    utf8 = F.col(text).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(utf8), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(utf8).cast("long").alias("text_crc32"),
        order.alias("ord"),
    )
    part = F.substring("ord", 1, digits).alias("part")
    places = (shard_of(F.col("doc_id"), tree).alias("shard"), part)
    counted = docs.select(F.col(key).alias("doc_id"), order.alias("ord")).select(*places).groupBy("shard", "part").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")
    starts = counted.select("shard", "part", before.alias("start"))  # at most SLOT_PARTS rows, or 16 a shard
    same = rows.groupBy("doc_id", "size", "text_crc32", "ord").agg(F.count("*").alias("copies"))
    placed = same.select("*", *places)
    window = Window.partitionBy("shard", "part").orderBy("ord", "doc_id", "size", "text_crc32")
    inside = placed.withColumn("first", F.sum("copies").over(window) - F.col("copies"))
    first = F.col("first") + F.col("start")
    return inside.join(F.broadcast(starts), ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("slot"),
        shard_of(F.col("doc_id"), grown).alias("grown_shard"),
    )


def with_shard(
    docs: DataFrame, *, key: str = "doc_id", shards: int = 8, tree: tuple[Leaf, ...] | None = None, grown: bool = False,
) -> DataFrame:
    """All columns and ``shard``; with ``grown`` also ``grown_shard``, the shard after one more is added.

    Columns of these names in the input, in upper or lower case, give way to the new ones.
    """
    tree = tree or default_tree(shards)
    made = {"shard": shard_of(F.col(key), tree)}
    if grown:
        made["grown_shard"] = shard_of(F.col(key), _grown(tree, shards))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    return docs.select(*kept, *(c.alias(name) for name, c in made.items()))


def _draw_sql(key: str, path: tuple[str, ...], weight: float) -> str:
    hexed = f"('0x' || substr(md5({key} || ':{'/'.join(path)}'), 1, {_DIGITS}))::BIGINT::DOUBLE"
    return f"ln(({hexed} + 0.5) / {float(16**_DIGITS)!r}) / {float(weight)!r}"


def shard_sql(key: str, tree: tuple[Leaf, ...], above: tuple[str, ...] = ()) -> str:
    """The same choice as SQL text."""
    if len(above) == 3:
        return above[-1]
    children = _children(tree, above, {})
    best = f"greatest({', '.join(_draw_sql(key, c, w) for c, w in children.items())})"
    cases = " ".join(f"WHEN {_draw_sql(key, c, w)} = {best} THEN {shard_sql(key, tree, c)}" for c, w in children.items())
    return f"CASE {cases} END"


def oracle(shards: int = 8) -> str:
    """The contract's rows in SQL; CRC-32 there has the reflected polynomial 0xEDB88320."""
    key = "coalesce(CAST(doc_id AS VARCHAR), '')"
    return f"""
    WITH RECURSIVE entry(n, i, v) AS (
        SELECT n, 0, n FROM range(256) r(n)
        UNION ALL SELECT n, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM entry WHERE i < 8),
    crc_table AS (SELECT list(v ORDER BY n) AS t FROM entry WHERE i = 8),
    sized AS (SELECT doc_id, {key} AS k, octet_length(encode(coalesce(text, ''))) + 1 AS size,
              CASE WHEN text IS NULL THEN NULL ELSE xor(list_reduce(
                  list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda b: ('0x' || b)::BIGINT)),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS text_crc32
              FROM documents, crc_table)
    SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY md5('slot:' || k), doc_id, size, text_crc32) - 1 AS slot, grown_shard
    FROM (SELECT *, {shard_sql('k', default_tree(shards))} AS shard, {shard_sql('k', default_tree(shards + 1))} AS grown_shard FROM sized)"""
