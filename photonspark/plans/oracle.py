"""DuckDB SQL of the detector queries."""

from __future__ import annotations

from photonspark.functions import decode
from photonspark.functions.clusters import Shape
from photonspark.operators import geometry
from photonspark.operators.histogram import bin_edges

PX = """px AS (SELECT l_orderkey % 64 AS frame, l_suppkey % 16 AS "row", l_partkey % 16 AS "col", CAST(floor(l_extendedprice) AS BIGINT) % 65536 AS raw, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)"""
IMG = """img AS (
  SELECT g.frame, g."row", g."col", coalesce(m.value, 0) AS value
  FROM (SELECT a.range AS frame, b.range AS "row", c.range AS "col" FROM range(64) AS a, range(16) AS b, range(16) AS c) AS g
  LEFT JOIN (SELECT frame, "row", "col", max(raw & 16383) AS value FROM px GROUP BY ALL) AS m USING (frame, "row", "col"))"""
HITS = """hits AS (SELECT user_id % 8 AS "row", event_id % 8 AS "col", value, ts, event_id FROM events)"""
SCAN = """scan AS (SELECT l_suppkey AS pixel, CAST(round(l_discount * 100) AS BIGINT) AS x, sum(CAST(floor(l_quantity) AS BIGINT))::BIGINT AS y FROM lineitem GROUP BY ALL)"""
GAIN = "CASE raw >> 14 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END"


def cl(n: int = 9) -> str:
    return f"cl AS (SELECT vec_id, vec_id % 400 AS x, (vec_id // 400) % 400 AS y, list_transform(embedding[1:{n}], lambda e: CAST(floor(CAST(e AS DOUBLE) * 1000 + 0.5) AS BIGINT)) AS data FROM embeddings)"


def q(*parts: str) -> str:
    *views, select = parts
    more = "" if select.lstrip().upper().startswith("SELECT") else ", "
    return (f"WITH {', '.join(views)}{more} " if views else "") + select


def spread(sql: str, n: int, *keys: str) -> str:
    """One column for each element of the array ``data``."""
    return f"SELECT {', '.join(keys)}, {', '.join(f'data[{i + 1}] AS d{i}' for i in range(n))} FROM ({sql})"


def bits(word: str, picks: tuple[int, ...]) -> str:
    return " + ".join(f"((({word}) >> {b}) & 1) * {1 << i}" for i, b in enumerate(picks))


WORD = "(l_orderkey * 2654435761 + l_partkey * 40503) % 4294967296"


def div(a: str, b: str) -> str:
    return f"coalesce(({a})::DOUBLE / nullif(({b})::DOUBLE, 0), 0.0)"


def blocks(shape: Shape) -> tuple[dict[int, str], str, str]:
    """SQL of the block sums, the largest, and its corner."""
    sums = {c: "(" + " + ".join(f"data[{i + 1}]" for i in at) + ")" for c, at in shape.blocks().items()}
    best = f"greatest({', '.join(sums.values())})" if len(sums) > 1 else next(iter(sums.values()))
    corner = "CASE " + " ".join(f"WHEN {s} = {best} THEN {c}" for c, s in sums.items()) + " END"
    return sums, best, corner


def eta(kind: str, shape: Shape) -> str:
    """SELECT vec_id, x, y, corner, energy FROM cl."""
    d = lambda i: f"data[{i + 1}]"
    c, s = shape.center, shape.sx
    _, best, corner = blocks(shape)
    if kind == "eta2":
        x = {0: div(d(c), f"{d(c - 1)} + {d(c)}"), 1: div(d(c + 1), f"{d(c)} + {d(c + 1)}")}
        y = {0: div(d(c), f"{d(c - s)} + {d(c)}"), 1: div(d(c + s), f"{d(c)} + {d(c + s)}")}
        ex, ey = f"CASE WHEN corner IN (0, 2) THEN {x[0]} ELSE {x[1]} END", f"CASE WHEN corner IN (0, 1) THEN {y[0]} ELSE {y[1]} END"
    elif kind == "full_eta2":
        pick = lambda k: "CASE corner " + " ".join(f"WHEN {n} THEN {div(f'{d(at[k[0]])} + {d(at[k[1]])}', 'energy')}" for n, at in shape.blocks().items()) + " END"
        ex, ey = pick((1, 3)), pick((2, 3))
    else:
        best, corner = " + ".join(map(d, range(9))), "0"
        if kind == "eta3":
            ex, ey = div("data[3] + data[6] + data[9] - data[1] - data[4] - data[7]", "energy"), div("data[7] + data[8] + data[9] - data[1] - data[2] - data[3]", "energy")
        else:
            ex, ey = div("data[6] - data[4]", "data[4] + data[5] + data[6]"), div("data[8] - data[2]", "data[2] + data[5] + data[8]")
    return f"SELECT vec_id, x, y, {ex} AS eta_x, {ey} AS eta_y, corner, energy FROM (SELECT *, {best} AS energy, {corner} AS corner FROM cl)"


PED3 = f"""ped AS (SELECT gain, "row", "col", sum(v)::DOUBLE / count(*) AS mean, count(*) AS samples FROM (SELECT {GAIN} AS gain, "row", "col", raw & 16383 AS v FROM px) GROUP BY ALL)"""
EDGES = "[0.0, 5000.0, 10000.0, 20000.0, 40000.0, 60000.0]"
GRID8 = """cube AS (
  SELECT a.range AS ix, b.range AS iy, c.range AS ie, coalesce(n, 0) AS n
  FROM range(8) AS a, range(8) AS b, range(4) AS c LEFT JOIN cells ON ix = a.range AND iy = b.range AND ie = c.range)"""
CELLS = f"""eta AS ({eta("eta2", Shape(3, 3))}),
cells AS (
  SELECT least(CAST(floor((eta_x + 0.1) * (8 / 1.2000000000000002)) AS BIGINT), 7) AS ix, least(CAST(floor((eta_y + 0.1) * (8 / 1.2000000000000002)) AS BIGINT), 7) AS iy, least(CAST(floor((energy + 1000.0) * (4 / 5000.0)) AS BIGINT), 3) AS ie, count(*) AS n
  FROM eta WHERE eta_x >= -0.1 AND eta_x < 1.1 AND eta_y >= -0.1 AND eta_y < 1.1 AND energy >= -1000 AND energy < 4000 GROUP BY ALL)"""


def conditional(axis: str, others: str) -> str:
    first = f"sum(CASE WHEN {axis} = 0 THEN n ELSE 0 END) OVER (PARTITION BY {others})"
    norm = f"(sum(n) OVER (PARTITION BY {others}) - {first})"
    upto = f"sum(n) OVER (PARTITION BY {others} ORDER BY {axis} ROWS UNBOUNDED PRECEDING)"
    return f"({upto} - {first})::DOUBLE / CASE WHEN {norm} = 0 THEN 1 ELSE {norm} END"


CDF = f"cdf AS (SELECT ix, iy, ie, {conditional('ix', 'iy, ie')} AS ietax, {conditional('iy', 'ix, ie')} AS ietay FROM cube)"



def interpolated(dx: str, dy: str) -> str:
    cell = lambda edges, v: f"greatest(len(list_filter({edges!r}, lambda e: e < {v})) - 1, 0)"
    axis, energy = bin_edges(8, -0.1, 1.1), bin_edges(4, -1000.0, 4000.0)
    inside = "eta_x >= -0.1 AND eta_x < 1.1 AND eta_y >= -0.1 AND eta_y < 1.1 AND energy >= -1000 AND energy < 4000"
    placed = f"placed AS (SELECT *, {cell(axis, 'eta_x')} AS ix, {cell(axis, 'eta_y')} AS iy, {cell(energy, 'energy')} AS ie FROM eta WHERE {inside})"
    return q(cl(), CELLS, GRID8, CDF, placed, f"SELECT vec_id, round(x + {dx}, 6) AS px, round(y + {dy}, 6) AS py, energy FROM placed JOIN cdf USING (ix, iy, ie)")


ERF = "sign(z) * (1.0::DOUBLE - t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-z * z))"

POL1 = "SELECT pixel, {p0} AS p0, {p1} AS p1 FROM (SELECT pixel, sum({w})::DOUBLE AS s0, sum({w} * x)::DOUBLE AS sx, sum({w} * y)::DOUBLE AS sy, sum({w} * x * x)::DOUBLE AS sxx, sum({w} * x * y)::DOUBLE AS sxy FROM scan GROUP BY pixel)"
_DET = "nullif(s0 * sxx - sx * sx, 0)"


def pol1(weight: str) -> str:
    return q(SCAN, POL1.format(w=weight, p0=f"round((sxx * sy - sx * sxy) / {_DET}, 6)", p1=f"round((s0 * sxy - sx * sy) / {_DET}, 6)"))


def pol2() -> str:
    def det(m):
        (a, b, d), (e, f, g), (h, i, j) = m
        return f"({a} * ({f} * {j} - {g} * {i}) - {b} * ({e} * {j} - {g} * {h}) + {d} * ({e} * {i} - {f} * {h}))"

    rows = [[f"x{i + k}" for k in range(3)] for i in range(3)]
    cols = [f"round({det([[f'y{i}' if k == at else rows[i][k] for k in range(3)] for i in range(3)])} / nullif({det(rows)}, 0), 6) AS p{at}" for at in range(3)]
    sums = [f"sum({'1' if not k else 'x ** ' + str(k)})::DOUBLE AS x{k}" for k in range(5)] + [f"sum(y * {'1' if not k else 'x ** ' + str(k)})::DOUBLE AS y{k}" for k in range(3)]
    return q(SCAN, f"SELECT pixel, {', '.join(cols)} FROM (SELECT pixel, {', '.join(sums)} FROM scan GROUP BY pixel)")


MICRO = """p AS (
  SELECT "row", "col", sum(value)::DOUBLE / 64 AS mean, sqrt(greatest((sum(value * value) * 64 - sum(value) * sum(value))::DOUBLE, 0.0)) / 64 AS std FROM img GROUP BY ALL),
v AS (SELECT frame, "row", "col", CAST(floor((value - mean) * 1000000 + 0.5) AS BIGINT) AS v, std * 1000000 AS rms FROM img JOIN p USING ("row", "col"))"""


def frozen() -> str:
    cell = lambda dy, dx: f"CAST(round(coalesce(max(CASE WHEN n.\"row\" = v.\"row\" + {dy} AND n.\"col\" = v.\"col\" + {dx} THEN n.v END), 0)::DOUBLE / 1000000) AS BIGINT)"
    data = ", ".join(cell(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    return q(PX, IMG, MICRO, f"""
SELECT frame, x, y, data FROM (
  SELECT v.frame, v."col" AS x, v."row" AS y, v.v, v.rms, greatest(max(n.v), 0) AS most, sum(n.v) AS total, [{data}] AS data
  FROM v JOIN v AS n ON n.frame = v.frame AND n."row" BETWEEN v."row" - 1 AND v."row" + 1 AND n."col" BETWEEN v."col" - 1 AND v."col" + 1
  GROUP BY v.frame, v."col", v."row", v.v, v.rms)
WHERE v >= -rms AND v = most AND (most > rms OR total > 3 * rms)""")


def gain_map() -> str:
    return q(cl(), """
px9 AS (SELECT vec_id, x, y, pos - 1 AS pos, data[pos] AS v FROM (SELECT *, unnest(range(1, 10)) AS pos FROM cl)),
s AS (
  SELECT vec_id, x, y, pos, CASE WHEN x < 1 OR y < 1 OR x >= 399 OR y >= 399 THEN 0
    ELSE CAST(trunc(v * (1.0::DOUBLE / (1 + ((y + pos // 3 - 1) * 7 + (x + pos % 3 - 1)) % 5))) AS BIGINT) END AS v
  FROM px9)
SELECT vec_id, x, y, list(v ORDER BY pos) AS data FROM s GROUP BY ALL""")


def moench05(channels: int, adc: tuple[int, ...]) -> str:
    return f"SELECT a.range AS \"row\", b.range AS \"col\", (a.range * 50 + b.range % 50) * {channels} + {list(adc)}[b.range // 50 + 1] AS src_index FROM range(160) AS a, range(150) AS b"


def strips(columns: tuple[int, ...], lower: str) -> str:
    return f"SELECT CASE WHEN {lower} THEN 200 + i // 32 // 25 ELSE 199 - i // 32 // 25 END AS \"row\", {list(columns)}[i % 32 + 1] + i // 32 % 25 AS \"col\", i AS src_index FROM (SELECT range AS i FROM range(160000))"


MATTERHORN10 = """SELECT r AS "row", c AS "col", c // 64 * 8 + c % 64 // 8 * 32 + c % 8 + r % 256 * 512 + 256 * CASE WHEN r % 256 < 128 THEN r // 256 ELSE 1 - r // 256 END AS src_index
FROM (SELECT a.range AS r, b.range AS c FROM range(512) AS a, range(256) AS b)"""
MATTERHORN02 = """SELECT k.range AS counter, a.range AS "row", b.range AS "col",
  (a.range * 24 + b.range % 24) + (a.range * 24 + b.range % 24) // 4 * 4 + b.range // 24 * 4 + k.range * 2304 AS src_index
FROM range(4) AS k, range(48) AS a, range(48) AS b"""

ROI = """SELECT module, row_index, col_index, greatest(ox - 300, 0) AS origin_x, greatest(oy - 100, 0) AS origin_y,
  least(ox + 512, 900) - greatest(ox, 300) AS width, least(oy + 256, 400) - greatest(oy, 100) AS height
FROM (SELECT *, col_index * 512 AS ox, row_index * 256 AS oy FROM (
  SELECT m AS module, m % 2 AS row_index, m // 2 AS col_index FROM (SELECT range AS m FROM range(4))))
WHERE ox < 900 AND ox + 512 > 300 AND oy < 400 AND oy + 256 > 100"""

SYNC = """WITH m AS (SELECT DISTINCT l_suppkey % 4 AS module, l_orderkey % 997 AS frame_number FROM lineitem),
i AS (SELECT module, frame_number, row_number() OVER (PARTITION BY module ORDER BY frame_number) - 1 AS idx FROM m),
c AS (SELECT frame_number FROM m GROUP BY frame_number HAVING count(*) = 4),
w AS (SELECT idx, max(frame_number) AS at_least FROM i GROUP BY idx HAVING count(*) = 4)
SELECT idx, (SELECT min(frame_number) FROM c WHERE frame_number >= at_least) AS frame_number FROM w WHERE (SELECT min(frame_number) FROM c WHERE frame_number >= at_least) IS NOT NULL"""

RUNNING = q(HITS, """o AS (SELECT "row", "col", CAST(floor(value * 100) AS BIGINT)::DOUBLE AS v, row_number() OVER (PARTITION BY "row", "col" ORDER BY ts, event_id) AS k FROM hits),
r AS (
  SELECT "row", "col", k, 1::BIGINT AS samples, v AS total, v * v AS total2 FROM o WHERE k = 1
  UNION ALL
  SELECT o."row", o."col", o.k, least(samples + 1, 20), CASE WHEN samples < 20 THEN total + o.v ELSE total + (o.v - total / 20) END, CASE WHEN samples < 20 THEN total2 + o.v * o.v ELSE total2 + (o.v * o.v - total2 / 20) END
  FROM r JOIN o ON o."row" = r."row" AND o."col" = r."col" AND o.k = r.k + 1)
SELECT "row", "col", samples, round(total, 6) AS total, round(total / samples, 6) AS mean
FROM r JOIN (SELECT "row", "col", max(k) AS k FROM o GROUP BY ALL) USING ("row", "col", k)""").replace("WITH hits", "WITH RECURSIVE hits")

COMPONENTS = q(PX, IMG, """hot AS (SELECT frame, "row", "col", "row" * 16 + "col" AS id FROM img WHERE value > 15000),
l AS (
  SELECT frame, id, id AS label FROM hot
  UNION
  SELECT l.frame, b.id, l.label FROM l JOIN hot AS a ON a.frame = l.frame AND a.id = l.id JOIN hot AS b ON b.frame = a.frame AND abs(b."row" - a."row") <= 1 AND abs(b."col" - a."col") <= 1 AND b.id <> a.id)
SELECT frame, label, count(*) AS size FROM (SELECT frame, id, min(label) AS label FROM l GROUP BY ALL) GROUP BY ALL""").replace("WITH px", "WITH RECURSIVE px")

# An ordered recursion over the values of a pixel; a value counts if it is near the mean of those before.
THRESHOLD = q(HITS, """o AS (SELECT "row", "col", value AS v, row_number() OVER (PARTITION BY "row", "col" ORDER BY ts, event_id) AS k FROM hits),
r AS (
  SELECT "row", "col", 0::BIGINT AS k, 0::BIGINT AS samples, 0::DOUBLE AS total, 0::DOUBLE AS total2, 0::DOUBLE AS mean FROM o WHERE k = 1
  UNION ALL
  SELECT "row", "col", k, n, t, t2, CASE WHEN near THEN t / n ELSE mean END
  FROM (
    SELECT *, CASE WHEN near THEN least(samples + 1, 50) ELSE samples END AS n,
      CASE WHEN NOT near THEN total WHEN samples < 50 THEN total + v ELSE total + (v - total / 50) END AS t,
      CASE WHEN NOT near THEN total2 WHEN samples < 50 THEN total2 + v * v ELSE total2 + (v * v - total2 / 50) END AS t2
    FROM (SELECT o."row", o."col", o.k, o.v, samples, total, total2, mean, abs(o.v - mean) < 60 AS near FROM r JOIN o ON o."row" = r."row" AND o."col" = r."col" AND o.k = r.k + 1)))
SELECT "row", "col", samples, round(total, 6) AS total, round(total2, 6) AS total2, round(mean, 6) AS mean,
  round(CASE WHEN samples = 0 THEN 0 ELSE sqrt(greatest(total2 / samples - (total / samples) ** 2, 0)) END, 6) AS std
FROM r JOIN (SELECT "row", "col", max(k) AS k FROM o GROUP BY ALL) USING ("row", "col", k)""").replace("WITH hits", "WITH RECURSIVE hits")

# The same with 32-bit floats: seeds fill the pedestal, later values are binned about it and, if quiet, pushed.
TRACKING = """WITH RECURSIVE """ + PX + """,
o AS (
  SELECT "row", "col", (raw & 16383)::FLOAT AS v, l_orderkey % 64 < 16 AS seed,
    row_number() OVER (PARTITION BY "row", "col" ORDER BY l_orderkey % 64 >= 16, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM px),
r AS (
  SELECT "row", "col", 0::BIGINT AS k, 0::BIGINT AS n, 0::FLOAT AS total, 0::FLOAT AS total2, 0::FLOAT AS mean, 0::FLOAT AS sigma, true AS seeding, NULL::BIGINT AS bin FROM o WHERE k = 1
  UNION ALL
  SELECT "row", "col", k, n, total, total2, CASE WHEN quiet AND NOT seed THEN total / n::FLOAT ELSE mean END, sigma, seeding AND seed,
    CASE WHEN NOT seed AND residual >= -8000 AND residual < 8000 THEN least(CAST(floor((residual::DOUBLE + 8000) * (64 / 16000.0::DOUBLE)) AS BIGINT), 63) END
  FROM (
    SELECT "row", "col", k, seed, seeding, mean, sigma, residual, quiet, CASE WHEN quiet THEN least(n + 1, 1000) ELSE n END AS n,
      CASE WHEN NOT quiet THEN total WHEN n < 1000 THEN total + v ELSE total + (v - total / 1000::FLOAT) END AS total,
      CASE WHEN NOT quiet THEN total2 WHEN n < 1000 THEN total2 + v * v ELSE total2 + (v * v - total2 / 1000::FLOAT) END AS total2
    FROM (
      SELECT *, seed OR (sigma > 0 AND abs(residual) < sigma) AS quiet
      FROM (
        SELECT *, v - mean AS residual
        FROM (
          SELECT o."row", o."col", o.k, o.v, o.seed, n, total, total2, seeding,
            CASE WHEN o.seed OR NOT seeding THEN mean WHEN n = 0 THEN 0 ELSE total / n::FLOAT END AS mean,
            CASE WHEN o.seed OR NOT seeding THEN sigma WHEN n = 0 THEN 0 ELSE sqrt(greatest(total2 / n::FLOAT - (total / n::FLOAT) * (total / n::FLOAT), 0::FLOAT))::FLOAT END AS sigma
          FROM r JOIN o ON o."row" = r."row" AND o."col" = r."col" AND o.k = r.k + 1)))))
SELECT "row", "col", bin, least(count(*), 65535) AS count FROM r WHERE bin IS NOT NULL GROUP BY ALL"""

MODULE = 'SELECT frame AS frame_index, "row" // 8 AS module, frame AS frame_number, "row" % 8 AS "row", "col", value FROM img'
REGION = 'SELECT {k} AS roi, frame AS frame_number, "row" - {y0} AS "row", "col" - {x0} AS "col", value FROM img WHERE "row" >= {y0} AND "row" < {y1} AND "col" >= {x0} AND "col" < {x1}'
FILED = "SELECT vec_id // 7 - 5 AS frame_number, x, y, {data} FROM cl"


SQL: dict[str, str] = {
    "d1_gain_value": q(PX, f"SELECT l_orderkey, l_linenumber, l_partkey, raw & 16383 AS value, {GAIN} AS gain FROM px"),
    "d4_sar05678": f"SELECT l_orderkey, l_linenumber, l_partkey, {bits(WORD, decode.SAR_05_06_07_08)} AS decoded FROM lineitem",
    "d5_sar05": f"SELECT l_orderkey, l_linenumber, l_partkey, {bits(WORD, decode.SAR_05)} AS decoded FROM lineitem",
    "d6_sar04": f"SELECT l_orderkey, l_linenumber, l_partkey, {bits(WORD, decode.SAR_04)} AS decoded FROM lineitem",
    "d8_custom_weights": q(PX, "SELECT l_orderkey, l_linenumber, l_partkey, round(" + " + ".join(f"((raw >> {i}) & 1) * {1.5 + i / 10!r}::DOUBLE ** {i}" for i in range(12)) + ", 6) AS weighted FROM px"),
    "d9_mask24": f"SELECT l_orderkey, l_linenumber, l_partkey, ({WORD} >> 4) & 16777215 AS masked FROM lineitem",
    "d10_expand24": "SELECT doc_id, " + ", ".join(" + ".join(f"('0x' || substr(h, {6 * i + 2 * k + 1}, 2))::BIGINT * {256**k}" for k in range(3)) + f" AS d{i}" for i in range(5)) + " FROM (SELECT doc_id, md5(doc_id::VARCHAR) AS h FROM documents)",
    "d11_expand4to8": "SELECT doc_id, " + ", ".join(f"('0x' || substr(h, {i + 2 if i % 2 == 0 else i}, 1))::BIGINT AS d{i}" for i in range(8)) + " FROM (SELECT doc_id, md5(doc_id::VARCHAR) AS h FROM documents)",
    "d17_duration": "SELECT event_id, CAST(round((event_id % 1000) * [1, 1000, 1000000, 1000000000, 1000000000][event_id % 5 + 1]) AS BIGINT) AS ns FROM events",
    "d19_safe_divide": "SELECT l_orderkey, l_linenumber, l_partkey, coalesce(l_extendedprice / nullif(l_discount, 0), 0.0) AS ratio FROM lineitem",
    "a1_last_smaller": f"SELECT o_orderkey, greatest(len(list_filter({EDGES}, lambda e: e < o_totalprice / 5)) - 1, 0) AS idx FROM orders",
    "a2_first_larger": f"SELECT o_orderkey, least(len(list_filter({EDGES}, lambda e: e <= o_totalprice / 5)), 5) AS idx FROM orders",
    "a3_nearest": f"SELECT o_orderkey, list_position(list_transform({EDGES}, lambda e: abs(e - o_totalprice / 5)), list_min(list_transform({EDGES}, lambda e: abs(e - o_totalprice / 5)))) - 1 AS idx FROM orders",
    "a4_cumsum": 'SELECT event_id, sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM events',
    "c1_sum": q(cl(), "SELECT vec_id, CAST(list_sum(data) AS BIGINT) AS total FROM cl"),
    "c2_max2x2": q(cl(), "SELECT vec_id, {1} AS sum, {2} AS corner FROM cl".format(*blocks(Shape(3, 3)))),
    "c2_max2x2_5x5": q(cl(25), "SELECT vec_id, {1} AS sum, {2} AS corner FROM cl".format(*blocks(Shape(5, 5)))),
    "c3_reduce2x2": spread(q(cl(), "SELECT vec_id, CASE {2} WHEN 0 THEN [data[1], data[2], data[4], data[5]] WHEN 1 THEN [data[2], data[3], data[5], data[6]] WHEN 2 THEN [data[4], data[5], data[7], data[8]] ELSE [data[5], data[6], data[8], data[9]] END AS data FROM cl".format(*blocks(Shape(3, 3)))), 4, "vec_id"),
    "c4_reduce3x3": spread(q(cl(25), "SELECT vec_id, [data[7], data[8], data[9], data[12], data[13], data[14], data[17], data[18], data[19]] AS data FROM cl"), 9, "vec_id"),
    **{f"{n}_{k}": q(cl(), eta(k, Shape(3, 3))) for n, k in (("c5", "eta2"), ("c7", "full_eta2"), ("c9", "eta3"), ("c10", "cross_eta3"))},
    "c5_eta2_5x5": q(cl(25), eta("eta2", Shape(5, 5))),
    "c6_eta2_2x2": q(cl(4), f"""SELECT vec_id, x, y,
  CASE WHEN corner IN (0, 1) THEN {div("data[4]", "data[3] + data[4]")} ELSE {div("data[2]", "data[1] + data[2]")} END AS eta_x,
  CASE WHEN corner IN (0, 2) THEN {div("data[4]", "data[2] + data[4]")} ELSE {div("data[3]", "data[1] + data[3]")} END AS eta_y, corner, energy
FROM (SELECT *, 4 - list_position(data, list_max(data)) AS corner, data[1] + data[2] + data[3] + data[4] AS energy FROM cl)"""),
    "c8_full_eta2_2x2": q(cl(4), f"""SELECT vec_id, x, y, {div("data[2] + data[4]", "energy")} AS eta_x, {div("data[3] + data[4]", "energy")} AS eta_y, corner, energy
FROM (SELECT *, 4 - list_position(data, list_max(data)) AS corner, data[1] + data[2] + data[3] + data[4] AS energy FROM cl)"""),
    "c14_concat": q(cl(), "SELECT vec_id, x, y, list_sum(data)::BIGINT AS total FROM (SELECT * FROM cl WHERE vec_id % 2 = 0 UNION ALL SELECT * FROM cl WHERE vec_id % 2 = 1 UNION ALL SELECT * FROM cl WHERE vec_id % 5 = 0)"),
    "c16_gain_map": spread(gain_map(), 9, "vec_id", "x", "y"),
    "f1_roi": q(cl(), "SELECT vec_id, x, y FROM cl WHERE x >= 20 AND x < 200 AND y >= 0 AND y < 1"),
    "f2_noise_cut": q(cl(), "SELECT vec_id, x, y FROM (SELECT *, {1} AS best, (x * 7 + y) % 40 AS n FROM cl) WHERE data[5] > n AND best > 2 * n AND list_sum(data) > 3 * n".format(*blocks(Shape(3, 3)))),
    "f5_hitmap_bounds": q(cl(), "SELECT vec_id, x, y FROM cl WHERE x < 100 AND y < 100"),
    "p2_pedestal_mean_std": q(PX, 'SELECT "row", "col", n AS samples, round(s::DOUBLE / n, 6) AS mean, round(sqrt(greatest((s2 * n - s * s)::DOUBLE, 0.0)) / n, 6) AS std FROM (SELECT "row", "col", count(*) AS n, sum(raw & 16383)::BIGINT AS s, sum((raw & 16383) * (raw & 16383))::BIGINT AS s2 FROM px GROUP BY ALL)'),
    "p6_pedestal3": q(PX, PED3, """SELECT g.range AS gain, a.range AS "row", b.range AS "col", coalesce(mean, 0.0) AS mean, coalesce(samples, 0) AS samples
FROM range(3) AS g, range(16) AS a, range(16) AS b LEFT JOIN ped ON ped.gain = g.range AND ped."row" = a.range AND ped."col" = b.range"""),
    "p7_pedestal_g0": q(PX, f'SELECT "row", "col", sum(raw & 16383)::DOUBLE / count(*) AS mean, count(*) AS samples FROM px WHERE {GAIN} = 0 GROUP BY ALL'),
    "p8_switching": q(PX, f'SELECT "row", "col", count(*) FILTER ({GAIN} <> 0) AS switches FROM px GROUP BY ALL'),
    "p9_calibrate3": q(PX, PED3, f'SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(((raw & 16383) - mean) / (1.0::DOUBLE + gain), 6) AS energy FROM (SELECT *, {GAIN} AS gain FROM px) JOIN ped USING (gain, "row", "col")'),
    "p10_calibrate_g0": q(PX, PED3, f'SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN {GAIN} <> 0 THEN 0.0 ELSE round(((raw & 16383) - mean) / 2.0::DOUBLE, 6) END AS energy FROM px JOIN (SELECT "row", "col", mean FROM ped WHERE gain = 0) USING ("row", "col")'),
    "h1_pixel_hist": q(PX, PED3, f"""SELECT "row", "col", bin, count(*) AS count FROM (
  SELECT "row", "col", least(CAST(floor((e + 8000.0) * (64 / 16000.0)) AS BIGINT), 63) AS bin
  FROM (SELECT "row", "col", ((raw & 16383) - mean) / (1.0::DOUBLE + gain) AS e FROM (SELECT *, {GAIN} AS gain FROM px) JOIN ped USING (gain, "row", "col")) WHERE e >= -8000 AND e < 8000) GROUP BY ALL"""),
    "h2_hist_u8": q(PX, 'SELECT "row", "col", bin, least(count(*), 255) AS count FROM (SELECT "row", "col", least(CAST(floor((raw & 16383) * (2 / 16384.0)) AS BIGINT), 1) AS bin FROM px) GROUP BY ALL'),
    "h7_hitmap": "SELECT (event_id // 7) % 50 AS \"row\", user_id % 60 AS \"col\", count(*) AS count FROM events WHERE user_id % 60 < 40 GROUP BY ALL",
    "h8_eta_cube": q(cl(), CELLS, "SELECT ix, iy, ie, n AS count FROM cells"),
    "i1_cdf": q(cl(), CELLS, GRID8, CDF, "SELECT * FROM cdf"),
    "i2_rosenblatt": q(cl(), CELLS, GRID8, f"""mx AS (SELECT ix, ie, sum(CASE WHEN ix = 0 THEN 0 ELSE n END) AS m FROM cube GROUP BY ALL),
rx AS (SELECT ix, ie, sum(m) OVER (PARTITION BY ie ORDER BY ix ROWS UNBOUNDED PRECEDING)::DOUBLE / CASE WHEN sum(m) OVER (PARTITION BY ie) = 0 THEN 1 ELSE sum(m) OVER (PARTITION BY ie) END AS ietax FROM mx)
SELECT ix, iy, ie, ietax, {conditional('iy', 'ix, ie')} AS ietay FROM cube JOIN rx USING (ix, ie)"""),
    "i4_interpolate": interpolated("0.5 + ietax + CASE WHEN corner IN (0, 2) THEN -1 ELSE 0 END", "0.5 + ietay + CASE WHEN corner IN (0, 1) THEN -1 ELSE 0 END"),
    "i5_interpolate_with": interpolated("ietax", "ietay"),
    "m1_moench03": strips(geometry.MOENCH03_COLUMNS, "i % 32 // 4 % 2 = 1"),
    "m2_moench04": strips(tuple(a % 16 * 25 for a in geometry.MOENCH04_ADC), "i % 32 >= 16"),
    "m3_moench05": moench05(12, (5, 9, 1)),
    "m3_moench05_1g": moench05(3, (1, 2, 0)),
    "m3_moench05_old": moench05(32, (9, 13, 1)),
    "m4_eiger_flip": 'SELECT a.range AS "row", b.range AS "col", (255 - a.range) * 512 + b.range AS src_index FROM range(256) AS a, range(512) AS b',
    "m5_matterhorn02": MATTERHORN02,
    "m6_matterhorn10": MATTERHORN10,
    "m7_geometry": "SELECT m AS module, m // 2 * 512 AS origin_x, m % 2 * 256 AS origin_y, 256 AS height, 512 AS width, m % 2 AS row_index, m // 2 AS col_index FROM (SELECT range AS m FROM range(4))",
    "m8_roi_geometry": ROI,
    "m9_gather": q(PX, IMG, 'SELECT frame, 15 - "row" AS "row", "col", value FROM img'),
    "j1_frame_sync": SYNC,
    "g1_clusters_frozen": spread(frozen(), 9, "frame", "x", "y"),
    "g4_components": COMPONENTS,
    "p1_pedestal_running": RUNNING,
    "r1_pol1": pol1("1"),
    "r1w_pol1_weighted": pol1("(1 + x % 3)"),
    "r2_pol2": pol2(),
    "r9_gauss_start": q(SCAN, "peak AS (SELECT pixel, max(y) AS height FROM scan GROUP BY pixel)", "SELECT pixel, height, min(x) FILTER (y = height) AS mu, (max(x) FILTER (2 * y > height) - min(x) FILTER (2 * y > height)) / 2.35::DOUBLE AS sigma FROM scan JOIN peak USING (pixel) GROUP BY ALL"),
    "r10_erf": f"SELECT l_orderkey, l_linenumber, l_partkey, round({ERF}, 9) AS erf FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * abs(z)) AS t FROM (SELECT *, (l_quantity - 25) / 10 AS z FROM lineitem))",
    "d20_scurve": f"SELECT l_orderkey, l_linenumber, l_partkey, round(5.0::DOUBLE + 0.1::DOUBLE * l_quantity + 0.5::DOUBLE * (1.0::DOUBLE + {ERF}) * (100.0::DOUBLE + 0.5::DOUBLE * (l_quantity - 25)), 6) AS y FROM (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + 0.3275911::DOUBLE * abs(z)) AS t FROM (SELECT *, (l_quantity - 25) / (sqrt(2.0::DOUBLE) * 6.0::DOUBLE) AS z FROM lineitem))",
    "r12_chi2": q(SCAN, "SELECT pixel, round(sum((y - 3 * x) * (y - 3 * x))::DOUBLE, 6) AS chi2 FROM scan GROUP BY pixel"),
    "p4_threshold": THRESHOLD,
    "h5_tracking_hist": TRACKING,
    "s1_raw_frames": q(PX, IMG, MODULE),
    "s2_seek_frames": q(PX, IMG, f"SELECT frame_index, module, sum(value)::BIGINT AS total FROM ({MODULE}) WHERE frame_index >= 20 AND frame_index < 30 GROUP BY ALL"),
    "s7_regions": q(PX, IMG, REGION.format(k=0, x0=2, x1=9, y0=5, y1=13) + " UNION ALL " + REGION.format(k=1, x0=0, x1=16, y0=0, y1=3)),
    "s9_stitched": q(PX, IMG, 'SELECT frame AS frame_number, "row", "col", value FROM img'),
    "s13_master_file": "SELECT '7.2' AS version, 'Jungfrau' AS detector_type, 'auto' AS timing_mode, '2' AS geometry_row, '1' AS geometry_col, '256' AS image_size_bytes, '16' AS pixels_x, '8' AS pixels_y, '16' AS bitdepth, '25' AS max_frames_per_file, '1' AS frame_padding, '5000000000' AS exptime_ns, '1000000' AS period_ns, 'UNKNOWN' AS reading_mode",
    "s17_board_frames": q(PX, IMG, 'SELECT frame AS frame_index, "row" * 16 + "col" AS sample, value FROM img'),
    "s21_npy_frames": q(PX, IMG, 'SELECT frame AS frame_index, "row", "col", value::DOUBLE AS value FROM img'),
    "s23_cluster_files": q(cl(), FILED.format(data=", ".join(f"data[{i + 1}] AS d{i}" for i in range(9)))),
    "s25_cluster_region": q(cl(), "SELECT vec_id // 7 - 5 AS frame_number, x, y FROM cl WHERE vec_id // 7 - 5 BETWEEN -3 AND 20 AND x >= 10 AND x < 100 AND y >= 0 AND y < 2"),
}
