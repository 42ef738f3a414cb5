"""Parts of oracle SQL, and short names for the tables that queries read."""

from __future__ import annotations

#: Whole-number vectors (0..255), float vectors, sign bits, and the queries: every row whose id is divisible by 20.
TABLES = """v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 128) AS BIGINT) + 128) AS vec, label FROM embeddings),
f AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS vec, label FROM embeddings),
b AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END) AS bits, label FROM embeddings),
q AS (SELECT id AS query_id, vec, label FROM v WHERE id % 20 = 0), fq AS (SELECT id AS query_id, vec FROM f WHERE id % 20 = 0), bq AS (SELECT id AS query_id, bits FROM b WHERE id % 20 = 0)"""


def sql(body: str, *more: str) -> str:
    """``body`` over the tables, and over ``more`` named ones."""
    return "WITH " + ", ".join([TABLES, *more]) + " " + body


def fold(expression: str, x: str, y: str, kind: str = "BIGINT") -> str:
    """Sum over both vectors' elements, in order; ``a`` and ``b`` stand for them."""
    each = f"list_transform(list_zip({x}, {y}), lambda p: {expression.replace('{a}', 'p[1]').replace('{b}', 'p[2]')})"
    return f"list_sum({each})::BIGINT" if kind == "BIGINT" else f"list_reduce({each}, lambda s, t: s + t)"


def l2(x: str, y: str) -> str:
    return fold("({a} - {b}) * ({a} - {b})", x, y)


def dot(x: str, y: str) -> str:
    return fold("{a} * {b}", x, y)


def hamming(x: str, y: str) -> str:
    return fold("abs({a} - {b})", x, y)


def top(pairs: str, k: int, descending: bool = False, key: str = "query_id") -> str:
    """The k best of each query of a query that gives query_id, id, dist."""
    return f"SELECT query_id, rank::INTEGER AS rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY dist {'DESC' if descending else ''}, id) - 1 AS rank FROM ({pairs})) WHERE rank < {k}"


#: Integer distances of all queries to all rows.
PAIRS = f"SELECT q.query_id, v.id, {l2('q.vec', 'v.vec')} AS dist FROM q, v"
#: Eight lists: the vectors of ids 0 to 7 are their centroids; each row is in the list of the nearest (the first of equals).
LISTS = f"""c AS (SELECT id AS list_no, vec AS centroid FROM v WHERE id < 8),
a AS (SELECT id, vec, label, list_no, cd FROM (SELECT v.*, c.list_no, {l2('v.vec', 'c.centroid')} AS cd, row_number() OVER (PARTITION BY v.id ORDER BY {l2('v.vec', 'c.centroid')}, c.list_no) AS n FROM v, c) WHERE n = 1),
p AS (SELECT query_id, vec, list_no, probe::INTEGER AS probe, cd FROM (SELECT q.query_id, q.vec, c.list_no, {l2('q.vec', 'c.centroid')} AS cd, row_number() OVER (PARTITION BY q.query_id ORDER BY {l2('q.vec', 'c.centroid')}, c.list_no) - 1 AS probe FROM q, c) WHERE probe < 3)"""


def joined(*columns: str) -> str:
    """Arrays of whole numbers as text: ``expression AS name`` each."""
    return ", ".join(f"array_to_string({c.rpartition(' AS ')[0]}, ',') AS {c.rpartition(' AS ')[2]}" for c in columns)


def texts(df, *columns: str):
    """The same for a frame's columns."""
    from pyspark.sql import functions as F

    return df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), ",") for c in columns})
