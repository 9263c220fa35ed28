"""DuckDB SQL for the segmentation queries, built from the same settings.

The loop is unrolled into one statement of materialised steps; components are
a recursion over pixels.
"""

from __future__ import annotations

from pixeloom.config import MANHATTAN, Config
from pixeloom.operators.seeds import columns_per_band

GAMMA = """gamma AS MATERIALIZED (SELECT i, floor(CAST(lin AS FLOAT) * CAST(8192 AS FLOAT))::INT AS v FROM (
  SELECT i::INT AS i, CASE WHEN i / 255.0::DOUBLE <= 0.04045::DOUBLE THEN i / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((i / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END AS lin FROM range(256) r(i)))"""
LABF = """labf AS MATERIALIZED (SELECT i, floor((f * CAST(8192 AS FLOAT))::DOUBLE + 0.5::DOUBLE)::INT AS v FROM (
  SELECT i::INT AS i, CASE WHEN CAST(i AS FLOAT) / CAST(8192 AS FLOAT) < CAST(0.008856 AS FLOAT)
    THEN CAST(7.787 AS FLOAT) * (CAST(i AS FLOAT) / CAST(8192 AS FLOAT)) + CAST(0.137931 AS FLOAT)
    ELSE CAST(pow(CAST(CAST(i AS FLOAT) / CAST(8192 AS FLOAT) AS DOUBLE), CAST(CAST(0.333333 AS FLOAT) AS DOUBLE)) AS FLOAT) END AS f FROM range(8193) r(i)))"""

EVENTS = """shape AS (SELECT floor(sqrt(count(*)))::BIGINT AS w, count(*) // floor(sqrt(count(*)))::BIGINT AS h FROM events),
rgb AS MATERIALIZED (SELECT 0::BIGINT AS image_id, (event_id // w)::INT AS y, (event_id % w)::INT AS x, (floor(value)::BIGINT % 256)::INT AS r, (user_id * 17 % 256)::INT AS g,
  (51 * (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1))::INT AS b FROM events, shape WHERE event_id // w < h)"""
TILES = """rgb AS MATERIALIZED (SELECT (event_id // 256)::BIGINT AS image_id, (event_id % 256 // 16)::INT AS y, (event_id % 16)::INT AS x, (floor(value)::BIGINT % 256)::INT AS r, (user_id * 17 % 256)::INT AS g,
  (51 * (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1))::INT AS b FROM events WHERE event_id // 256 < (SELECT count(*) // 256 FROM events))"""
VECTORS = """flat AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
rgb AS MATERIALIZED (SELECT 0::BIGINT AS image_id, vec_id::INT AS y, p::INT AS x, least(255, greatest(0, floor(e::DOUBLE * 200)::BIGINT + 128))::INT AS r, r AS g, r AS b FROM flat)"""


def synthetic(width: int, height: int) -> str:
    return f"""rgb AS MATERIALIZED (SELECT 0::BIGINT AS image_id, (i // {width})::INT AS y, (i % {width})::INT AS x, (i % {width} * 4 % 256)::INT AS r, (i // {width} * 5 % 256)::INT AS g,
  (((i % {width}) // 8 + (i // {width}) // 8) % 2 * 255)::INT AS b FROM range({width * height}) t(i))"""


_CLAMP = "greatest(0, least(255, (({w} * ({d}) + 1048576) >> 12) - 128))::INT"
PIXELS = f"""{GAMMA}, {LABF},
light AS (SELECT image_id, y, x, gr.v AS sr, gg.v AS sg, gb.v AS sb FROM rgb JOIN gamma gr ON gr.i = r JOIN gamma gg ON gg.i = g JOIN gamma gb ON gb.i = b),
px AS MATERIALIZED (SELECT image_id, y, x, ((116 * fy.v - 131072) >> 12)::INT AS l, {_CLAMP.format(w=500, d="fx.v - fy.v")} AS a, {_CLAMP.format(w=200, d="fy.v - fz.v")} AS b
  FROM light JOIN labf fx ON fx.i = (28440 * sr + 24656 * sg + 12442 * sb) >> 16 JOIN labf fy ON fy.i = (13938 * sr + 46868 * sg + 4730 * sb) >> 16
  JOIN labf fz ON fz.i = (1164 * sr + 7175 * sg + 57202 * sb) >> 16)"""


def shapes(clusters: int) -> str:
    return f"""shapes AS MATERIALIZED (SELECT image_id, (max(x) + 1)::INT AS w, (max(y) + 1)::INT AS h,
  floor(CAST(sqrt(CAST((max(x) + 1)::BIGINT * (max(y) + 1) AS FLOAT) / CAST({clusters} AS FLOAT)) AS FLOAT))::INT AS s FROM px GROUP BY image_id)"""


def places(clusters: int) -> str:
    share = columns_per_band(clusters)
    n = len(share)
    return f"""bands AS (SELECT *, unnest(range(CAST(ceil(h / hb) AS BIGINT)))::INT AS band FROM (SELECT *, CAST(ceil(h / {n}.0) AS INT) AS hb FROM shapes)),
cells AS (SELECT *, CAST(ceil(w / ({share}[least(band, {n - 1}) + 1])::DOUBLE) AS INT) AS wb FROM bands),
grid AS (SELECT *, unnest(range(CAST(ceil(w / wb) AS BIGINT)))::INT AS cell FROM cells),
numbered AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY band, cell) - 1)::INT AS k FROM grid),
placed AS (SELECT image_id, k, least(band * hb + hb // 2, h - 1)::INT AS cy, least(cell * wb + wb // 2, w - 1)::INT AS cx, w, h, s FROM numbered WHERE k < {clusters}),
have AS (SELECT image_id, w, h, s, count(*) AS n FROM placed GROUP BY ALL),
places AS (SELECT * FROM placed UNION ALL SELECT image_id, unnest(range(n, {clusters}))::INT, (h // 2)::INT, (w // 2)::INT, w, h, s FROM have WHERE n < {clusters})"""


CLUSTERS0 = """c0 AS MATERIALIZED (SELECT p.image_id, k, cx, cy, l, a, b, 0::BIGINT AS num_members, w, h, s FROM places p JOIN px ON px.image_id = p.image_id AND px.y = cy AND px.x = cx)"""
STATE0 = """s0 AS MATERIALIZED (SELECT px.*, w, h, s, NULL::INT AS k, NULL::INT AS min_dist FROM px JOIN shapes USING (image_id))"""


def distance(config: Config) -> str:
    row = "greatest(c.cy, p.s)" if config.top_clip else "c.cy"
    dx, dy = "abs(p.x - c.cx)", f"abs(p.y - {row})"
    offset = f"CAST({dx} + {dy} AS FLOAT)" if config.distance_metric == MANHATTAN else f"CAST(sqrt(({dx} * {dx} + {dy} * {dy})::DOUBLE) AS FLOAT)"
    weight = f"(CAST(1 AS FLOAT) / (CAST(p.s AS FLOAT) / CAST({config.compactness} AS FLOAT)) * CAST(2 AS FLOAT))"
    return f"(abs(p.l - c.l) + abs(p.a - c.a) + abs(p.b - c.b) + CASE WHEN p.s > 0 THEN floor({weight} * {offset})::BIGINT ELSE 0 END)"


def assign(n: int, m: int, config: Config, start: int, stride: int) -> str:
    """s{n + 1} from s{n} and c{m}."""
    sampled = "TRUE" if stride == 1 else f"p.y % {stride} = {start}"
    return f"""best{n} AS MATERIALIZED (SELECT p.image_id, p.y, p.x, min(({distance(config)} << 32) | (c.cy::BIGINT << 16) | c.k::BIGINT) AS key
  FROM s{n} p JOIN c{m} c ON c.image_id = p.image_id AND p.x BETWEEN c.cx - p.s AND c.cx + p.s AND p.y BETWEEN c.cy - p.s AND c.cy + p.s WHERE {sampled} GROUP BY ALL),
s{n + 1} AS MATERIALIZED (SELECT p.image_id, p.y, p.x, l, a, b, w, h, s, coalesce((key & 65535)::INT, k) AS k, CASE WHEN {sampled} THEN (key >> 32)::INT ELSE min_dist END AS min_dist
  FROM s{n} p LEFT JOIN best{n} q ON q.image_id = p.image_id AND q.y = p.y AND q.x = p.x)"""


def update(n: int, m: int, start: int, stride: int) -> str:
    """c{m + 1} from s{n} and c{m}."""
    mean = lambda c, old: f"coalesce(((sum_{c} + n // 2) // n)::INT, {old}) AS {old}"
    where = "" if stride == 1 else f"AND y % {stride} = {start}"
    return f"""sums{m} AS (SELECT image_id, k, count(*) AS n, sum(y)::BIGINT AS sum_y, sum(x)::BIGINT AS sum_x, sum(l)::BIGINT AS sum_l, sum(a)::BIGINT AS sum_a, sum(b)::BIGINT AS sum_b FROM s{n} WHERE k IS NOT NULL {where} GROUP BY ALL),
c{m + 1} AS MATERIALIZED (SELECT c.image_id, c.k, {mean("x", "cx")}, {mean("y", "cy")}, {mean("l", "l")}, {mean("a", "a")}, {mean("b", "b")}, coalesce(n, num_members) AS num_members, w, h, s
  FROM c{m} c LEFT JOIN sums{m} u ON u.image_id = c.image_id AND u.k = c.k)"""


def loop(config: Config) -> tuple[list[str], int, int]:
    """The steps of the loop and the last assignment; numbers of the last state and clusters."""
    steps, start, n = [], 0, 0
    for _ in range(config.max_iterations):
        steps += [assign(n, n, config, start, config.subsample_stride), update(n + 1, n, start, config.subsample_stride)]
        n, start = n + 1, (start + 1) % config.subsample_stride
    return [*steps, assign(n, n, config, 0, 1)], n + 1, n


def connectivity(state: str, config: Config) -> str:
    """root (pixels with their component's first pixel), comp, big, labels (image_id, y, x, label) from a state."""
    return f"""root AS (SELECT image_id, i, min(r) AS r FROM reach GROUP BY ALL),
comp AS MATERIALIZED (SELECT r.image_id, r.r AS leader, count(*) AS members, any_value(w) AS w, any_value(s) AS s, (row_number() OVER (PARTITION BY r.image_id ORDER BY r.r) - 1)::BIGINT AS comp FROM root r JOIN (SELECT DISTINCT image_id, w, s FROM {state}) USING (image_id) GROUP BY r.image_id, r.r),
sized AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY members DESC, leader) AS place FROM comp WHERE members >= floor(CAST(s * s AS FLOAT) * CAST({config.min_size_factor} AS FLOAT) + 0.5::DOUBLE)),
big AS MATERIALIZED (SELECT image_id, leader, members, (row_number() OVER (PARTITION BY image_id ORDER BY leader) - 1)::INT AS label FROM sized WHERE place <= {config.num_of_clusters}),
named AS MATERIALIZED (SELECT c.image_id, c.leader, coalesce(b.label, CASE WHEN c.leader = 0 THEN 0 END) AS label, c.w FROM comp c LEFT JOIN big b USING (image_id, leader)),
link AS MATERIALIZED (SELECT n.image_id, n.leader, r.r AS parent FROM named n JOIN root r ON r.image_id = n.image_id AND r.i = CASE WHEN n.leader % n.w > 0 THEN n.leader - 1 ELSE n.leader - n.w END WHERE n.label IS NULL),
chase(image_id, leader, label) AS (SELECT image_id, leader, label FROM named WHERE label IS NOT NULL UNION ALL SELECT k.image_id, k.leader, c.label FROM link k JOIN chase c ON c.image_id = k.image_id AND c.leader = k.parent),
labels AS MATERIALIZED (SELECT r.image_id, (r.i // c.w)::INT AS y, (r.i % c.w)::INT AS x, ch.label FROM root r JOIN comp c ON c.image_id = r.image_id AND c.leader = r.r JOIN chase ch ON ch.image_id = r.image_id AND ch.leader = r.r)"""


def edges(state: str) -> str:
    return f"""idx AS MATERIALIZED (SELECT image_id, y, x, k, y::BIGINT * w + x AS i, w FROM {state}),
near AS MATERIALIZED (SELECT p.image_id, p.i AS i, q.i AS j FROM idx p JOIN idx q ON q.image_id = p.image_id AND q.k IS NOT DISTINCT FROM p.k AND (q.i = p.i - 1 AND p.x > 0 OR q.i = p.i - p.w)),
both_ways AS MATERIALIZED (SELECT image_id, i, j FROM near UNION ALL SELECT image_id, j, i FROM near),
reach(image_id, i, r) USING KEY (image_id, i) AS (SELECT image_id, i, i FROM idx UNION
  SELECT e.image_id, e.j, min(f.r) FROM reach f JOIN both_ways e ON e.image_id = f.image_id AND e.i = f.i JOIN recurring.reach t ON t.image_id = e.image_id AND t.i = e.j WHERE f.r < t.r GROUP BY ALL)"""


def with_(*parts: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select
