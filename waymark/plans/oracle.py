"""The queries again, as SQL that runs on the same tables: common table
expressions by name, and a select over them for each query."""

from __future__ import annotations

import re

BLEND = "(VALUES ('geo5c', 0.22::DOUBLE), ('geo10c', 0.22::DOUBLE), ('geo25c', 0.22::DOUBLE), ('cls_wh', 0.34::DOUBLE)) bl(space, w)"


def hav(a: str, b: str) -> str:
    half = f"pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)"
    return f"2 * 6371.0088::DOUBLE * asin(sqrt(least(greatest({half}, 0), 1)))"


def unit(x: str, eps: str) -> str:
    return f"list_transform({x}, lambda e: e / {eps.format(n=f'sqrt(list_dot_product({x}, {x}))')})"


def coordinates(cell: str, key: str) -> str:
    return (
        f"-60::DOUBLE + 7.5::DOUBLE * {cell} + ({key} * 7919 % 1000) / 1000::DOUBLE * 0.6::DOUBLE AS lat, "
        f"-170::DOUBLE + 21::DOUBLE * {cell} + ({key} * 104729 % 1000) / 1000::DOUBLE * 0.6::DOUBLE AS lon"
    )


RERANK = (0.5, 1.0, -0.2, -0.5, 0.3, 0.6, 0.2, 0.1, 0.4, 0.5, -0.1, 0.2, 0.3, 0.4, -0.3, 0.1)
NAMES = "score raw log_rank margin cons10 cons25 cons50 diffusion cc_mean cc_max3 entropy fill score_cons25 raw_cons25 margin_cons25 diffusion_cons25".split()
CONFIDENCE = list(zip("agree10 agree25 agree100 top_sim margin entropy log_candidates".split(), (0.4, 0.8, 0.3, 0.9, 0.5, -0.2, -0.1), (0.1, 0.2, 0.8, 0.3, 0.4, 3.5, 5.0), (0.1, 0.2, 0.3, 0.2, 0.5, 0.6, 1.0)))

CTES = {
    "emb": "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings",
    "cen": "SELECT vec_id::INT AS cell, v FROM emb WHERE vec_id < 16",
    "qv": "SELECT vec_id AS qid, v FROM emb WHERE vec_id >= 16 AND vec_id % 10 = 9",
    "pv": "SELECT vec_id AS rid, v FROM emb WHERE vec_id >= 16 AND vec_id % 10 <> 9",
    "cellmap": "SELECT rid, cell FROM pv p, cen c QUALIFY row_number() OVER (PARTITION BY rid ORDER BY list_dot_product(p.v, c.v) DESC, cell) = 1",
    "meanv": "SELECT list(m ORDER BY i) AS m FROM (SELECT i, round(avg(x), 9) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pv) GROUP BY i)",
    "allv": "SELECT rid AS id, 'p' AS kind, v FROM pv UNION ALL SELECT qid, 'q', v FROM qv",
    "raws": "SELECT id, kind, 'cls' AS space, v AS u FROM allv UNION ALL SELECT id, kind, 'geo5c', v[1:32] FROM allv UNION ALL SELECT id, kind, 'geo10c', v[17:48] FROM allv UNION ALL SELECT id, kind, 'geo25c', v[33:64] FROM allv UNION ALL SELECT id, kind, 'cls_wh', list_transform(list_zip(v, m), lambda t: t[1] - t[2]) FROM allv, meanv",
    "sp": f"SELECT id, kind, space, CASE WHEN space = 'cls' THEN u ELSE {unit('u', 'greatest({n}, 1e-12)')} END AS f FROM raws",
    "code": "SELECT id AS rid, space, f, scale, list_transform(f, lambda e: greatest(least(round_even(e / scale, 0), 127::DOUBLE), -127::DOUBLE)) AS code FROM (SELECT *, greatest(list_max(list_transform(f, lambda e: abs(e))), 1e-12) / 127 AS scale FROM sp WHERE kind = 'p')",
    "csls": "SELECT rid, space, avg(d) AS csls FROM (SELECT a.id AS rid, a.space, list_dot_product(a.f, b.f) AS d FROM sp a JOIN sp b ON a.space = b.space AND a.kind = 'p' AND b.kind = 'p' AND b.id IN (SELECT rid FROM pv ORDER BY rid * 7919 % 100003, rid LIMIT 5000) WHERE a.space IN ('geo5c', 'geo10c', 'geo25c') QUALIFY row_number() OVER (PARTITION BY a.id, a.space ORDER BY list_dot_product(a.f, b.f) DESC) <= 10) GROUP BY ALL",
    "logit": "SELECT qid, cell, 20 * list_dot_product(q.v, c.v) AS logit FROM qv q, cen c",
    "post": "SELECT qid, cell, e / sum(e) OVER (PARTITION BY qid) AS p FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY qid)) AS e FROM logit)",
    "ordered": "SELECT *, row_number() OVER w AS rank, coalesce(sum(p) OVER (PARTITION BY qid ORDER BY p DESC, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM post WINDOW w AS (PARTITION BY qid ORDER BY p DESC, cell)",
    "gated": "SELECT qid, cell, p, rank FROM ordered WHERE rank <= 400 AND before < 0.95",
    "part": f"SELECT g.qid, m.rid, g.p, sum(2 * w * scale * list_dot_product(q.f, k.code)) AS d FROM gated g JOIN cellmap m USING (cell) JOIN code k ON k.rid = m.rid JOIN {BLEND} USING (space) JOIN sp q ON q.kind = 'q' AND q.id = g.qid AND q.space = k.space GROUP BY ALL",
    "hub": f"SELECT rid, sum(w * csls) AS h FROM csls JOIN {BLEND} USING (space) GROUP BY rid",
    "scored": "SELECT qid, rid, d - h + 0.05::DOUBLE * ln(greatest(p, 1e-12)) AS s FROM part JOIN hub USING (rid)",
    "topk": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rid) - 1 AS rank FROM scored QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, rid) <= 100",
    "csls_all": "SELECT rid, space, avg(d) AS csls FROM (SELECT a.id AS rid, a.space, list_dot_product(a.f, b.f) AS d FROM sp a JOIN sp b ON a.space = b.space AND a.kind = 'p' AND b.kind = 'p' WHERE a.space IN ('geo5c', 'geo10c', 'geo25c') QUALIFY row_number() OVER (PARTITION BY a.id, a.space ORDER BY list_dot_product(a.f, b.f) DESC) <= 10) GROUP BY ALL",
    "hub_all": f"SELECT rid, sum(w * csls) AS h FROM csls_all JOIN {BLEND} USING (space) GROUP BY rid",
    "scored_all": "SELECT qid, rid, d - h + 0.05::DOUBLE * ln(greatest(p, 1e-12)) AS s FROM part JOIN hub_all USING (rid)",
    "topk_all": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, rid) - 1 AS rank FROM scored_all QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, rid) <= 100",
    "coords": f"SELECT rid, cell, {coordinates('cell', 'rid')} FROM cellmap",
    "wts": "SELECT *, e / (sum(e) OVER (PARTITION BY qid) + 1e-12) AS w FROM (SELECT *, exp((s - max(s) OVER (PARTITION BY qid)) / 0.05) AS e FROM topk)",
    "tops": f"SELECT t.*, c.lat, c.lon, list_dot_product(q.f, k.code) * k.scale AS raw, {unit('k.code', '({n} + 1e-9)')} AS u FROM wts t JOIN coords c USING (rid) JOIN code k ON k.rid = t.rid AND k.space = 'cls' JOIN sp q ON q.kind = 'q' AND q.id = t.qid AND q.space = 'cls'",
    "pairs": f"SELECT a.qid, a.rid, b.rid AS other, b.w AS w_other, {hav('a.', 'b.')} AS km, list_dot_product(a.u, b.u) AS cc FROM tops a JOIN tops b USING (qid)",
    "cons": "SELECT qid, rid, sum(CASE WHEN km <= 10 THEN w_other ELSE 0 END) AS cons10, sum(CASE WHEN km <= 25 THEN w_other ELSE 0 END) AS cons25, sum(CASE WHEN km <= 50 THEN w_other ELSE 0 END) AS cons50, sum(CASE WHEN km <= 100 THEN w_other ELSE 0 END) AS cons100, sum(cc * w_other) AS cc_mean, sum(CASE WHEN cc > 0.5 THEN cc * w_other ELSE 0 END) / (sum(CASE WHEN cc > 0.5 THEN cc ELSE 0 END) + 1e-12) AS d, coalesce(list_avg(list_reverse_sort(list(cc))[2:4]), 0) AS cc_max3 FROM pairs GROUP BY ALL",
    "whole": "SELECT qid, -sum(w * ln(greatest(w, 1e-12))) AS entropy, count(*) AS k, max(s) AS best FROM tops GROUP BY qid",
    "feat": "SELECT qid, rid, rank, s, s AS score, raw, ln(1 + rank) AS log_rank, best - s AS margin, cons10, cons25, cons50, cons100, d * 10 AS diffusion, cc_mean, cc_max3, entropy, k / 100 AS fill, s * cons25 AS score_cons25, raw * cons25 AS raw_cons25, (best - s) * cons25 AS margin_cons25, d * cons25 * 10 AS diffusion_cons25 FROM tops JOIN cons USING (qid, rid) JOIN whole USING (qid)",
    "linear": f"SELECT *, -0.7::DOUBLE + {' + '.join(f'({w}::DOUBLE) * {n}' for w, n in zip(RERANK, NAMES))} AS e7 FROM feat",
    "final": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, rank) - 1 AS place FROM (SELECT *, s / 0.2::DOUBLE + 2 * e7 AS final FROM linear)",
    "ncand": "SELECT qid, count(*) AS n_candidates FROM gated JOIN cellmap USING (cell) GROUP BY qid",
    "won": "SELECT a.qid, a.rid, a.s, a.final, n_candidates, a.cons10 AS agree10, a.cons25 AS agree25, a.cons100 AS agree100, a.raw AS top_sim, coalesce(a.final - b.final, 0) AS margin, a.entropy, ln(1 + n_candidates) AS log_candidates FROM final a LEFT JOIN final b ON b.qid = a.qid AND b.place = 1 JOIN ncand n ON n.qid = a.qid WHERE a.place = 0",
    "conf": f"SELECT *, 1 / (1 + exp(-(-0.4::DOUBLE + {' + '.join(f'({w}::DOUBLE) * (({n}) - {m}::DOUBLE) / {sd}::DOUBLE' for n, w, m, sd in CONFIDENCE)}))) AS confidence FROM won",
    "truth": f"SELECT qid, {coordinates('cell', 'qid')} FROM logit QUALIFY row_number() OVER (PARTITION BY qid ORDER BY logit DESC, cell) = 1",
    "nat": "SELECT n_nationkey AS k, n_name AS name, (-150 + 60 * (n_nationkey % 6))::DOUBLE AS cx, (-60 + 30 * (n_nationkey // 6))::DOUBLE AS cy, (18 + (n_nationkey % 3) * 4)::DOUBLE AS hx, (9 + n_nationkey % 4)::DOUBLE AS hy FROM nation",
    "ring": """SELECT k * 10 AS feature_id, name, 0 AS ring, [{'x': cx - hx, 'y': cy - hy}, {'x': cx + hx, 'y': cy - hy}, {'x': cx + hx + 2, 'y': cy}, {'x': cx + hx, 'y': cy + hy}, {'x': cx - hx, 'y': cy + hy}] AS pts FROM nat
      UNION ALL SELECT k * 10, name, 1, [{'x': cx - hx / 3, 'y': cy - hy / 3}, {'x': cx + hx / 3, 'y': cy - hy / 3}, {'x': cx + hx / 3, 'y': cy + hy / 3}, {'x': cx - hx / 3, 'y': cy + hy / 3}] FROM nat WHERE k % 5 = 0
      UNION ALL SELECT k * 10 + 1, name, 0, [{'x': cx - 0.5, 'y': cy + hy + 1.5}, {'x': cx + 0.5, 'y': cy + hy + 1.5}, {'x': cx + 0.5, 'y': cy + hy + 2.5}, {'x': cx - 0.5, 'y': cy + hy + 2.5}] FROM nat WHERE k % 7 = 3""",
    "edge": "SELECT feature_id, name, ring, pts[i].x AS x1, pts[i].y AS y1, pts[i % len(pts) + 1].x AS x2, pts[i % len(pts) + 1].y AS y2 FROM (SELECT *, unnest(range(1, len(pts) + 1)) AS i FROM ring)",
    "pt": "SELECT c_custkey AS point_id, (c_custkey * 37 % 1500) / 10::DOUBLE - 75 AS lat, (c_custkey * 101 % 3400) / 10::DOUBLE - 170 AS lon FROM customer",
    "crossed": "SELECT point_id, feature_id, any_value(name) AS name, ring, count(*) FILTER ((y1 > lat) <> (y2 > lat) AND lon < x1 + (lat - y1) * (x2 - x1) / nullif(y2 - y1, 0)) % 2 AS odd FROM pt, edge GROUP BY ALL",
    "held": "SELECT point_id, arg_min(name, feature_id) AS name, min(feature_id) AS feature_id FROM (SELECT point_id, feature_id, any_value(name) AS name FROM crossed GROUP BY ALL HAVING sum(CASE WHEN ring = 0 THEN odd ELSE 0 END) = 1 AND sum(CASE WHEN ring > 0 THEN odd ELSE 0 END) = 0) GROUP BY point_id",
    "plane": "SELECT point_id, feature_id, name, (x1 - lon) * kx AS ax, (y1 - lat) * 110.574::DOUBLE AS ay, (x2 - x1) * kx AS dx, (y2 - y1) * 110.574::DOUBLE AS dy FROM (SELECT *, 111.32::DOUBLE * cos(radians(lat)) AS kx FROM pt ANTI JOIN held USING (point_id)), edge",
    "coast": "SELECT point_id, feature_id, name, min(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))) AS km FROM (SELECT *, least(greatest(-(ax * dx + ay * dy) / CASE WHEN dx * dx + dy * dy = 0 THEN 1 ELSE dx * dx + dy * dy END, 0), 1) AS t FROM plane) GROUP BY ALL HAVING km < 50",
    "snap": "SELECT * FROM coast QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY km, feature_id) = 1",
    "ans": "SELECT o_orderkey AS qid, (o_orderkey * 7919 % 1009) / 1009::DOUBLE AS p, CASE WHEN o_orderkey * 31 % 1009 < o_orderkey * 7919 % 1009 THEN (o_orderkey % 250) / 10::DOUBLE ELSE 25.5::DOUBLE + o_orderkey * 13 % 3000 END AS km FROM orders",
    "rated": "SELECT *, (km <= 25)::INT AS y FROM ans",
    "settle": "SELECT s_name AS name, CASE WHEN s_suppkey % 11 <> 0 THEN (s_suppkey % 17)::INT END AS scalerank, CASE WHEN s_suppkey % 13 <> 0 THEN s_suppkey * 1000 % 70001 END AS pop_max, CASE s_suppkey % 5 WHEN 0 THEN 'Admin-0 capital' WHEN 1 THEN 'Admin-1 region capital' WHEN 2 THEN 'Populated place' END AS featurecla, (s_suppkey % 3 = 0)::INT AS adm0cap, CASE WHEN s_suppkey % 4 <> 1 THEN (s_suppkey % 4 = 0)::INT END AS megacity, (s_suppkey % 6 = 0)::INT AS worldcity, CASE WHEN s_suppkey % 7 <> 0 THEN (s_suppkey % 300)::INT END AS labelrank FROM supplier",
    "ranked": "SELECT *, least(greatest(coalesce(scalerank, 14), 0), 14) AS rank FROM settle",
    "mani": "SELECT page_id, url AS path, strlen(html) AS bytes FROM pages",
    "list": "SELECT path, bytes + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS bytes FROM mani WHERE page_id % 5 <> 0",
}


def descent(name: str, rows: str, names: list[str], steps: int, rate: float, l2: float) -> dict[str, str]:
    """Expressions <name>_x (standardised rows), <name>_w (weights of each fold by step,
    the bias last) for a fit of rows (fold, y, names) by gradient descent."""
    n = len(names)
    each = ", ".join(f"({x} - avg({x}) OVER ()) / (stddev_pop({x}) OVER () + 1e-9)" for x in names)
    gradient = ", ".join(f"sum(e * x[{i + 1}]) / count(*)" for i in range(n)) + ", sum(e) / count(*)"
    decay = f"list_transform(range(1, {n + 2}), lambda i: CASE WHEN i <= {n} THEN {l2}::DOUBLE * w[i] ELSE 0 END)"
    return {
        f"{name}_x": f"SELECT *, [{each}, 1] AS x FROM {rows}",
        f"{name}_of": f"SELECT f.fold, r.x, r.y FROM (SELECT DISTINCT fold FROM {name}_x UNION ALL SELECT -1) f JOIN {name}_x r ON r.fold <> f.fold",
        f"{name}_w": f"""SELECT fold, 0 AS step, list_transform(range({n + 1}), lambda i: 0::DOUBLE) AS w FROM (SELECT DISTINCT fold FROM {name}_of)
          UNION ALL SELECT fold, step, list_transform(range(1, {n + 2}), lambda i: w[i] - {rate}::DOUBLE * (g[i] + d[i])) FROM (
            SELECT fold, step, w, {decay} AS d, [{gradient}] AS g FROM (SELECT s.fold, s.step + 1 AS step, s.w, r.x, 1 / (1 + exp(-list_dot_product(s.w, r.x))) - r.y AS e FROM {name}_w s JOIN {name}_of r USING (fold) WHERE s.step < {steps}) GROUP BY fold, step, w)""",
    }


CTES["near"] = f"SELECT t.qid, t.rid, {hav('c.', 't.')} AS km FROM (SELECT qid, rid, truth.lat, truth.lon FROM topk JOIN truth USING (qid)) t JOIN coords c USING (rid)"
CTES["train"] = "SELECT feat.*, km, (km <= 25)::INT AS y, (qid // 10 % 5)::INT AS fold FROM feat JOIN near USING (qid, rid)"
CTES |= descent("rr", "train", NAMES, 400, 0.5, 0.0)
CTES["sure"] = "SELECT won.*, km, (km <= 25)::INT AS y, (qid // 10 % 5)::INT AS fold FROM won JOIN near USING (qid, rid)"
CTES |= descent("cf", "sure", [c[0] for c in CONFIDENCE], 900, 0.35, 1e-4)
CTES["feats"] = "SELECT DISTINCT feature_id, k, name, layer, n, pts FROM (SELECT feature_id, feature_id // 10 AS k, name, 'l' || (feature_id // 10 % 3) AS layer, count(*) OVER (PARTITION BY feature_id) AS n, pts FROM ring)"
CTES["newer"] = "SELECT name, rank, CASE WHEN name LIKE '%2' THEN pop_max + 1 ELSE pop_max END AS pop_max FROM ranked WHERE name NOT LIKE '%1'"
CTES["shapes"] = "SELECT feature_id // 10 AS k, 'l' || (feature_id // 10 % 3) AS layer, feature_id // 10 // 3 * 2 + feature_id % 10 AS num, name, list(pts ORDER BY ring) AS rings, [min(list_min(list_transform(pts, lambda p: p.x))), min(list_min(list_transform(pts, lambda p: p.y))), max(list_max(list_transform(pts, lambda p: p.x))), max(list_max(list_transform(pts, lambda p: p.y)))] AS box FROM ring GROUP BY feature_id, name"
CTES["old_map"] = "SELECT * FROM shapes UNION ALL SELECT * REPLACE ('old' AS layer) FROM shapes WHERE k = 1"
CTES["new_map"] = "SELECT * REPLACE (CASE k WHEN 3 THEN 'X' ELSE name END AS name, CASE k WHEN 7 THEN [box[1], box[2], box[3] + 1, box[4]] ELSE box END AS box, CASE k WHEN 9 THEN list_transform(rings, lambda r: list_reverse(r)) ELSE rings END AS rings) FROM shapes WHERE layer <> 'l2' OR k <> 2 UNION ALL SELECT * REPLACE ('new' AS layer) FROM shapes WHERE k = 0"
CTES["differing"] = "SELECT layer, CASE WHEN w.n IS NULL THEN 'layer removed' WHEN o.n IS NULL THEN 'layer added' WHEN o.n <> w.n THEN 'layer differs' END AS what FROM (SELECT layer, count(*) AS n FROM old_map GROUP BY layer) o FULL JOIN (SELECT layer, count(*) AS n FROM new_map GROUP BY layer) w USING (layer)"
CTES["pdim"] = "SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pv"
CTES["cov"] = "SELECT a.i, b.i AS j, covar_pop(a.x, b.x) AS c FROM pdim a JOIN pdim b USING (rid) GROUP BY ALL"
CTES["wide"] = "SELECT i, list_concat(list(c ORDER BY j), list_transform(range(1, count(*) + 1), lambda j: (i = j)::INT::DOUBLE)) AS line FROM cov GROUP BY i"
#: Elimination: a step divides line k + 1 by its own element and takes it off the others.
CTES["elim"] = """SELECT 0 AS k, list(line ORDER BY i) AS m FROM wide
  UNION ALL SELECT k + 1, list_transform(m, lambda line, i: CASE WHEN i = k + 1 THEN top ELSE list_transform(list_zip(line, top), lambda t: t[1] - line[k + 1] * t[2]) END)
  FROM (SELECT k, m, list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1]) AS top FROM elim WHERE k < len(m))"""
CTES["inverse"] = "SELECT list_transform(m, lambda line: line[len(m) + 1:]) AS inv FROM elim WHERE k = len(m)"
CTES["pix"] = "SELECT image, i // 8 AS y, i % 8 AS x, least(greatest(floor(128 + 100 * e), 0), 255)::INT AS value FROM (SELECT vec_id AS image, unnest(v) AS e, generate_subscripts(v, 1) - 1 AS i FROM emb)"
CTES["halves"] = "SELECT t, s, c / sum(c) OVER (PARTITION BY t) AS w FROM (SELECT t, s, CASE WHEN x < 1 THEN 1.5::DOUBLE * x ** 3 - 2.5::DOUBLE * x ** 2 + 1 WHEN x < 2 THEN -0.5::DOUBLE * (x ** 3 - 5 * x ** 2 + 8 * x - 4) ELSE 0 END AS c FROM (SELECT t, s, abs(s - 2 * t - 0.5::DOUBLE) / 2 AS x FROM range(4) a(t), range(8) b(s) WHERE s >= 2 * t - 3 AND s < 2 * t + 5))"
#: Expressions that are read in every step of a recursion.
KEPT = {"rr_of", "cf_of"}


def with_ctes(select: str) -> str:
    """The select behind the expressions that it uses, in order of need."""
    needed: list[str] = []
    open_names: set[str] = set()

    def add(text: str) -> None:
        for name in CTES:
            if name not in needed and name not in open_names and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                open_names.add(name)
                add(CTES[name])
                needed.append(name)

    add(select)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS {'MATERIALIZED ' * (n in KEPT)}({CTES[n]})" for n in needed) + " " + select if needed else select


def r(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0 AS {name or x}"


def rs(names: str) -> str:
    return ", ".join(r(n) for n in names.split())


def percentile(x: str) -> str:
    return f"quantile_cont({x}, 0.5)"


REPORT = f"count(*) AS n, {r(percentile('km'), 'median_km')}, {r('avg((km <= 25)::INT) * 100', 'at25')}, {r('avg((km > 1000)::INT) * 100', 'beyond1000')}"

SELECTS = {
    "quantise_rows": f"SELECT rid AS \"row\", space, round(scale, 9) + 0 AS scale, list_sum(code)::BIGINT AS total, list_sum(list_transform(list_zip(code, range(1, len(code) + 1)), lambda t: t[1] * t[2]))::BIGINT AS checksum FROM code",
    "flat_index": "SELECT row_number() OVER (ORDER BY cell, rid) - 1 AS \"row\", rid AS place, cell, round(lat, 3) + 0 AS lat, round(lon, 3) + 0 AS lon, 3 AS spaces, scale, cls, geo5c, geo10c, geo25c, cls_wh FROM coords JOIN (SELECT rid, "
    + ", ".join(f"max(c) FILTER (space = '{x}') AS {x}" for x in ("cls", "geo5c", "geo10c", "geo25c", "cls_wh"))
    + ", max(round(scale, 6)) FILTER (space = 'cls') AS scale FROM (SELECT rid, space, scale, list_sum(list_transform(list_zip(code, range(1, len(code) + 1)), lambda t: t[1] * t[2]))::BIGINT AS c FROM code) GROUP BY rid) USING (rid)",
    "dequant_dot": f"SELECT q.id AS qid, k.rid AS \"row\", {r('list_dot_product(q.f, k.code) * k.scale', 'product')} FROM sp q JOIN gated g ON g.qid = q.id JOIN cellmap m USING (cell) JOIN code k ON k.rid = m.rid AND q.kind = 'q' AND q.space = 'cls' AND k.space = 'cls'",
    "l2_normalise": f"SELECT id AS qid, space, {r('f[1]', 'first')}, {r('list_sum(f)', 'total')}, {r('list_dot_product(f, f)', 'length')} FROM sp WHERE kind = 'q'",
    "softmax_posterior": f"SELECT qid, cell, {r('p')} FROM post",
    "gate_mass": f"SELECT qid, cell, rank, {r('p')} FROM gated",
    "gate_cap": f"SELECT qid, cell, rank, {r('p')} FROM ordered WHERE rank <= 3 AND before < 0.95",
    "cell_assign": 'SELECT rid AS "row", cell FROM cellmap',
    "cell_histogram_offsets": 'SELECT c.cell, coalesce(n, 0)::BIGINT AS n, coalesce(sum(coalesce(n, 0)) OVER (ORDER BY c.cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM (SELECT unnest(range(16))::INT AS cell) c LEFT JOIN (SELECT cell, count(*) AS n FROM cellmap GROUP BY cell) USING (cell)',
    "csls_topk_mean": f"SELECT rid AS \"row\", space, {r('csls')} FROM csls",
    "prior_term": f"SELECT qid, cell, {r('0.05::DOUBLE * ln(greatest(p, 1e-12))', 'prior')} FROM gated",
    "blend_score": f"SELECT qid, rid AS \"row\", {r('s')} FROM scored",
    "topk_candidates": f"SELECT qid, rid AS \"row\", rank, {r('s')} FROM topk_all",
    "topk_20": f"SELECT qid, rid AS \"row\", rank, {r('s')} FROM topk_all WHERE rank < 20",
    "nearest_places_by_haversine": f"SELECT qid, rid AS \"row\", {r('km')} FROM (SELECT t.qid, c.rid, {hav('t.', 'c.')} AS km FROM truth t, coords c) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY km, rid) <= 5",
    "pair_affinity": f"SELECT qid, rid AS \"row\", count(*) FILTER (cc > 0.5) AS alike, {r('sum(CASE WHEN cc > 0.5 THEN cc ELSE 0 END)', 'affinity')}, {r('max(km)', 'furthest')} FROM pairs GROUP BY ALL",
    "consensus_weights": f"SELECT qid, rid AS \"row\", {r('w')} FROM wts",
    "consensus_radius": f"SELECT qid, rid AS \"row\", {rs('cons10 cons25 cons50')} FROM cons",
    "ccmean": f"SELECT qid, rid AS \"row\", {r('cc_mean')} FROM cons",
    "ccmax3": f"SELECT qid, rid AS \"row\", {r('cc_max3')} FROM cons",
    "affinity_diffusion": f"SELECT qid, rid AS \"row\", {r('d', 'diffusion')} FROM cons",
    "score_entropy": f"SELECT qid, k, {r('entropy')} FROM whole",
    "rerank_features": f"SELECT qid, rid AS \"row\", rank, {rs(' '.join(NAMES))} FROM feat",
    "rerank_linear_score": f"SELECT qid, rid AS \"row\", {r('e7')} FROM linear",
    "final_rank": f"SELECT qid, rid AS \"row\", place, {r('final')} FROM final",
    "confidence": f"SELECT qid, {rs('agree10 agree25 agree100 top_sim margin entropy log_candidates confidence')} FROM conf",
    "locate_flagship": f"SELECT o.qid, o.rid AS \"row\", {r('lat')}, {r('lon')}, n_candidates, gate_cells, {r('s')}, {r('final')}, {r('confidence')} FROM conf o JOIN coords USING (rid) JOIN (SELECT qid, count(*) AS gate_cells FROM gated GROUP BY qid) USING (qid)",
    "spread_top12": f"SELECT a.qid, {r('max(greatest(abs(ca.lat - cw.lat), abs(ca.lon - cw.lon) * cos(radians(cw.lat))))', 'span')} FROM final a JOIN coords ca ON ca.rid = a.rid JOIN won w ON w.qid = a.qid JOIN coords cw ON cw.rid = w.rid WHERE a.place < 12 GROUP BY a.qid",
    "error_report": f"SELECT count(*) AS n, {r(percentile('km'), 'median_km')}, {r('avg(km)', 'mean_km')}, {r('avg((km <= 1)::INT) * 100', 'at1')}, {r('avg((km <= 25)::INT) * 100', 'at25')}, {r('avg((km <= 200)::INT) * 100', 'at200')}, {r('avg(5000 * exp(-km / 1492.7::DOUBLE))', 'score')} FROM (SELECT {hav('t.', 'c.')} AS km FROM truth t JOIN won w USING (qid) JOIN coords c USING (rid))",
    "point_in_polygon": "SELECT point_id, feature_id, name FROM held",
    "nearest_coast_snap": f"SELECT point_id, feature_id, name, {r('km')} FROM snap",
    "country_at": f"SELECT pt.point_id, coalesce(held.name, snap.name) AS name, {r('CASE WHEN held.name IS NOT NULL THEN 0 ELSE km END', 'km')} FROM pt LEFT JOIN held USING (point_id) LEFT JOIN snap USING (point_id)",
    "mercator_roundtrip": f"SELECT point_id, {r('y')}, {r('degrees(2 * atan(exp(radians(y))) - pi() / 2)', 'lat')} FROM (SELECT point_id, degrees(ln(tan(pi() / 4 + radians(least(greatest(lat * 1.3, -85.05112878), 85.05112878)) / 2))) AS y FROM pt)",
    "format_latlon": "SELECT point_id, format('{:.5f}°{}, {:.5f}°{}', abs(lat), CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END, abs(lon), CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END) AS text FROM pt",
    "format_km": "SELECT qid, CASE WHEN km < 1 THEN format('{} m', trunc(km * 1000)::INT) WHEN km < 10 THEN format('{:.2f} km', km) WHEN km < 1000 THEN format('{:.1f} km', km) ELSE format('{:,} km', round(km)::BIGINT) END AS text FROM (SELECT qid, (qid % 4001) * 0.37::DOUBLE + 0.0012::DOUBLE AS km FROM ans)",
    "rank_prefix": "SELECT name, rank, coalesce(pop_max, 0) AS pop_max FROM ranked WHERE rank <= 6",
    "rank_index": "SELECT i AS rank, coalesce(n, 0)::BIGINT AS n, coalesce(sum(coalesce(n, 0)) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT unnest(range(16))::INT AS i) LEFT JOIN (SELECT rank, count(*) AS n FROM ranked GROUP BY rank) ON rank = i",
    "place_flags": "SELECT name, ((CASE WHEN adm0cap = 1 OR starts_with(coalesce(featurecla, ''), 'Admin-0 capital') THEN 1 ELSE 0 END) + (CASE WHEN starts_with(coalesce(featurecla, ''), 'Admin-1') THEN 2 ELSE 0 END) + (CASE WHEN megacity = 1 THEN 4 ELSE 0 END) + (CASE WHEN worldcity = 1 THEN 8 ELSE 0 END))::INT AS flags, rank, CASE WHEN labelrank IS NULL THEN 255 ELSE least(greatest(labelrank, 0), 255) END AS label_rank FROM ranked",
    "polygon_area_filter": f"SELECT country, part, {r('area')} FROM (SELECT name AS country, feature_id AS part, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM edge WHERE ring = 0 GROUP BY ALL) QUALIFY area >= 600 OR row_number() OVER (PARTITION BY country ORDER BY area DESC, part) = 1",
    "feature_boxes": f"SELECT feature_id, {r('min(x1) - 2e-4', 'min_lon')}, {r('max(x1) + 2e-4', 'max_lon')}, {r('min(y1) - 2e-4', 'min_lat')}, {r('max(y1) + 2e-4', 'max_lat')} FROM edge GROUP BY ALL",
    "map_difference": "SELECT coalesce(o.name, n.name) AS name, CASE WHEN n.name IS NULL THEN 'removed' WHEN o.name IS NULL THEN 'added' ELSE 'changed' END AS what FROM ranked o FULL JOIN newer n USING (name) WHERE o.name IS NULL OR n.name IS NULL OR (o.rank, o.pop_max) IS DISTINCT FROM (n.rank, n.pop_max)",
    "homonym_lookup": "SELECT asked, coalesce(e.name, b.name) AS name FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE s_name[1:5] || '?' END AS asked FROM supplier) LEFT JOIN (SELECT name FROM ranked QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank, coalesce(pop_max, 0) DESC) = 1) e ON e.name = asked LEFT JOIN (SELECT name, name[1:5] AS begin FROM ranked QUALIFY row_number() OVER (PARTITION BY name[1:5] ORDER BY rank, coalesce(pop_max, 0) DESC, name) = 1) b ON b.begin = asked[1:5]",
    "coordinate_quantise": "SELECT point_id, least(greatest(round_even(lat * 1e6, 0), -180e6), 180e6)::INT AS lat_q, least(greatest(round_even((lon * 1.1) * 1e6, 0), -180e6), 180e6)::INT AS lon_q FROM pt",
    "wrap_longitude": f"SELECT point_id, {r('CASE WHEN x BETWEEN -180 AND 180 THEN x ELSE x - 360 * ceil((x - 180) / 360) END', 'lon')} FROM (SELECT point_id, lon * 7.3::DOUBLE AS x FROM pt)",
    "spread_zoom": f"SELECT point_id, {r('least(greatest(log2(360 / (least(greatest(abs(lon) / 10 * 4, 3.6), 120) * (1 / greatest(cos(radians(lat)), 0.15)))), log2(greatest(1, 1920 / 1080))), 11)', 'zoom')} FROM pt",
    "project_to_screen": f"SELECT point_id, {r('x')}, {r('y')} FROM (SELECT point_id, 540 + (CASE WHEN lon - 10 BETWEEN -180 AND 180 THEN lon - 10 ELSE lon - 10 - 360 * ceil((lon - 190) / 360) END) * 6 AS x, 960 - (degrees(ln(tan(pi() / 4 + radians(lat) / 2))) - 20) * 6 AS y FROM pt) WHERE x BETWEEN -200 AND 1280 AND y BETWEEN -200 AND 2120",
    "scale_bar": f"SELECT point_id, km, {r('least(km / k, 220)', 'px')} FROM (SELECT point_id, k, coalesce(list_filter(steps, lambda s: s / k >= 88)[1], 5000) AS km FROM (SELECT point_id, 111.32::DOUBLE * cos(radians(lat)) / (1 + point_id % 900) AS k, [0.1, 0.2, 0.5, 1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000]::DOUBLE[] AS steps FROM pt))",
    "zoom_ranks": "SELECT point_id, CASE WHEN z < 2.4 THEN 3 WHEN z < 4.5 THEN 5 WHEN z < 14 THEN 7 END AS country_rank, CASE WHEN z < 2.6 THEN NULL WHEN z < 5 THEN 1 WHEN z < 10 THEN 2 WHEN z < 22 THEN 3 WHEN z < 50 THEN 4 WHEN z < 100 THEN 6 WHEN z < 220 THEN 7 WHEN z < 520 THEN 8 ELSE 10 END AS place_rank FROM (SELECT point_id, (point_id * 7 % 6000) / 10::DOUBLE AS z FROM pt)",
    "brier_auc": f"SELECT count(*) AS n, {r('avg(pow(p - y, 2))', 'brier')}, {r('avg(y) * (1 - avg(y))', 'base_brier')}, {r('any_value(won) / (sum(y) * (count(*) - sum(y)))', 'auc')} FROM rated, (SELECT sum(CASE WHEN y = 1 THEN below ELSE 0 END) AS won FROM (SELECT y, coalesce(sum(1 - y) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(1 - y) OVER (PARTITION BY p) AS below FROM rated))",
    "calibration_bins": f"SELECT low, count(*) AS n, {r('avg(y) * 100', 'actual')}, {r(percentile('km'), 'median_km')} FROM (SELECT *, CASE WHEN p < 0.1 THEN 0 WHEN p < 0.2 THEN 0.1 WHEN p < 0.3 THEN 0.2 WHEN p < 0.4 THEN 0.3 WHEN p < 0.5 THEN 0.4 WHEN p < 0.6 THEN 0.5 WHEN p < 0.7 THEN 0.6 WHEN p < 0.8 THEN 0.7 WHEN p < 0.9 THEN 0.8 ELSE 0.9 END::DOUBLE AS low FROM rated) GROUP BY low HAVING count(*) >= 20",
    "confidence_bands": f"SELECT CASE WHEN p >= 0.75 THEN 'high' WHEN p >= 0.45 THEN 'medium' ELSE 'low' END AS band, {REPORT} FROM rated GROUP BY band",
    "confidence_texts": "SELECT qid, format('{}% within 25 km', floor(p * 100 + 0.5)::INT) AS text, CASE WHEN p >= 0.7 THEN 'good' WHEN p >= 0.4 THEN 'warn' ELSE 'dim' END AS tier FROM rated",
    "signal_tiers": f"SELECT CASE WHEN i < n_all // 4 THEN 'best' WHEN i < 3 * n_all // 4 THEN 'mid' ELSE 'worst' END AS tier, {REPORT} FROM (SELECT km, row_number() OVER (ORDER BY p DESC, qid) - 1 AS i, count(*) OVER () AS n_all FROM rated) GROUP BY tier",
    "parity_report": f"SELECT count(*) AS n_files, count(gap) AS n_both, sum(same) AS same, {r('max(gap)', 'max_gap')}, {r('avg(gap)', 'mean_gap')}, {r(percentile('ms'), 'median_ms')}, CASE WHEN sum(same) = count(gap) THEN 'same' WHEN max(gap) < 1 THEN 'near' ELSE 'mismatch' END AS verdict FROM (SELECT {hav('a.', 'b.')} AS gap, (a.point_id % 97 <> 0)::INT AS same, ms FROM pt a LEFT JOIN (SELECT point_id, lat + 0.001::DOUBLE AS lat, lon, point_id * 13 % 700 AS ms FROM pt WHERE point_id % 3 <> 0) b USING (point_id)) WHERE true".replace("(a.point_id % 97 <> 0)::INT AS same", "CASE WHEN b.point_id IS NOT NULL THEN (a.point_id % 97 <> 0)::BIGINT END AS same"),
    "bench_median": "SELECT event_type, count(*) AS n, round(list_sort(list(value))[count(*) // 2 + 1], 6) + 0 AS median, round(min(value), 6) + 0 AS least FROM events GROUP BY event_type",
    "fold_assign": "SELECT qid % 5 AS fold, count(*) AS n, sum(y) AS hits FROM rated GROUP BY ALL",
    "feature_moments": "SELECT unnest(['p', 'km']) AS feature, round(unnest([avg(p), avg(km)]), 6) + 0 AS mean, round(unnest([stddev_pop(p) + 1e-9, stddev_pop(km) + 1e-9]), 6) + 0 AS sd FROM rated",
    "manifest_todo_anti": "SELECT path, bytes FROM mani WHERE NOT EXISTS (SELECT 1 FROM list l WHERE l.path = mani.path AND l.bytes = mani.bytes)",
    "manifest_mismatch": "SELECT m.path, m.bytes, l.bytes AS found FROM mani m LEFT JOIN list l USING (path) WHERE l.bytes IS NULL OR l.bytes <> m.bytes",
    "manifest_hashes": "SELECT path, bytes, sha256(html) AS sha256 FROM mani JOIN pages USING (page_id)",
    "view_select": 'SELECT l_orderkey AS "row", sum(l_quantity)::DOUBLE AS total FROM lineitem WHERE l_orderkey % 4 = 0 GROUP BY ALL',
    "download_text": "SELECT page_id, CASE WHEN speed > 1e4 THEN CASE WHEN s < 90 THEN format('{}s left', s) ELSE format('{} min left', (s + 30) // 60) END END AS text FROM (SELECT page_id, speed, trunc(strlen(html) * 9000 / speed)::INT AS s FROM (SELECT page_id, html, (page_id * 977 % 400000 + 1)::DOUBLE AS speed FROM pages))",
    "shard_order": "SELECT shard, i, row_number() OVER (ORDER BY shard, i) - 1 AS \"row\" FROM (SELECT regexp_extract('c2_cls_r' || (o_custkey % 12), '_r(\\d+)', 1)::INT AS shard, o_orderkey AS i FROM orders)",
    "layer_union": "SELECT layer, count(*) AS n, sum(rank)::BIGINT AS ranks FROM (SELECT 'places' AS layer, rank FROM ranked UNION ALL SELECT 'countries', k % 8 FROM nat) GROUP BY layer",
    "layer_names_removed": "SELECT DISTINCT n_name AS name FROM nation EXCEPT SELECT n_name FROM nation WHERE n_regionkey > 1",
    "rerank_models": f"SELECT fold, i - 1 AS i, {r('w[i]', 'w')}, {r('w[17]', 'b')} FROM (SELECT *, unnest(range(1, 17)) AS i FROM rr_w WHERE step = 400)".replace("i - 1 AS i", "(i - 1)::INT AS i"),
    "lambda_grid": f"SELECT lam, {r(percentile('km'), 'median_km')} FROM (SELECT lam, qid, km FROM (SELECT r.qid, r.rank, r.s, r.km, list_dot_product(w.w, r.x) AS z FROM rr_x r JOIN rr_w w ON w.fold = r.fold AND w.step = 400), (SELECT unnest([0.5, 1, 2]::DOUBLE[]) AS lam) QUALIFY row_number() OVER (PARTITION BY lam, qid ORDER BY s / 0.2::DOUBLE + lam * z DESC, rank) = 1) GROUP BY lam",
    "confidence_models": f"SELECT fold, (i - 1)::INT AS i, {r('w[i]', 'w')}, {r('w[8]', 'b')} FROM (SELECT *, unnest(range(1, 8)) AS i FROM cf_w WHERE step = 900)",
    "confidence_cv": f"SELECT qid, y, {r('1 / (1 + exp(-list_dot_product(w, x)))', 'p')} FROM cf_x JOIN cf_w USING (fold) WHERE step = 900",
    "score_sd": f"SELECT {r('stddev_pop(s)', 'score_sd')} FROM topk",
    "names_per_layer": "SELECT layer, count(*) AS n, count(DISTINCT name) AS names FROM (SELECT 'region' || n_regionkey AS layer, n_name[1:1] AS name FROM nation UNION ALL SELECT 'places', name FROM ranked) GROUP BY layer",
    "manifest_totals": "SELECT count(*) AS files, sum(bytes)::BIGINT AS bytes, count(*) FILTER (missing) AS files_left, coalesce(sum(bytes) FILTER (missing), 0)::BIGINT AS bytes_left FROM (SELECT bytes, NOT EXISTS (SELECT 1 FROM list l WHERE l.path = mani.path AND l.bytes = mani.bytes) AS missing FROM mani)",
    "head_rows": "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i, c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 32",
    "geometry_difference": "SELECT layer, NULL::BIGINT AS k, what FROM differing WHERE what IS NOT NULL UNION ALL SELECT layer, coalesce(o.num, w.num), CASE WHEN (o.name, len(o.rings)) IS DISTINCT FROM (w.name, len(w.rings)) THEN 'name or rings' WHEN o.box IS DISTINCT FROM w.box THEN 'box' ELSE 'coordinates' END FROM old_map o FULL JOIN new_map w USING (layer, num) JOIN differing USING (layer) WHERE differing.what IS NULL AND (o.name, o.box, o.rings) IS DISTINCT FROM (w.name, w.box, w.rings)",
    "place_cut": "SELECT name, rank, coalesce(pop_max, 0) AS pop_max, (k % 180)::DOUBLE AS lon, (k % 90)::DOUBLE AS lat FROM (SELECT *, regexp_extract(name, '[0-9]+$')::BIGINT AS k FROM ranked) WHERE rank <= 8 AND k % 19 <> 0 AND k % 23 <> 0",
    "unit_xyz": f"SELECT point_id, {r('cos(radians(lat)) * cos(radians(lon))', 'x')}, {r('cos(radians(lat)) * sin(radians(lon))', 'y')}, {r('sin(radians(lat))', 'z')} FROM pt",
    "usable_rings": "SELECT feature_id, count(*) FILTER (n >= 3)::INT AS rings FROM (SELECT feature_id, ring, CASE WHEN (feature_id / 10 + ring) % 4 < 1 THEN least(2, len(pts)) ELSE len(pts) END AS n FROM ring) GROUP BY feature_id HAVING min(n) FILTER (ring = 0) >= 3",
    "ring_repeats": f"SELECT feature_id, ring, len(pts)::INT AS n, {r('list_sum(list_transform(pts, lambda p: p.x + 2 * p.y))', 'total')} FROM ring",
    "run_drift": f"SELECT {r('avg(c)', 'mean_cosine')}, {r('max(m)', 'max_difference')}, {r('avg((qid % 11 <> 0)::INT) * 100', 'same_cell')} FROM (SELECT qid, list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w)) AS c, list_max(list_transform(list_zip(v, w), lambda t: abs(t[1] - t[2]))) AS m FROM (SELECT qid, v, list_transform(v, lambda e: round(e, 2)) AS w FROM qv))",
    "clean_names": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN trim(s_name) WHEN s_suppkey % 5 <> 0 THEN 'alt' || s_suppkey END AS name FROM supplier",
    "northing_limit": f"SELECT point_id, {r('greatest(0, 180 - 1920 / (1080 * pow(2, point_id % 12) / 360) / 2)', 'limit')} FROM pt".replace("AS limit", 'AS "limit"'),
    "image_numbers": "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN (page_id % 9000)::INT END AS i FROM pages",
    "inner_points": f"SELECT feature_id, {r('(a + b) / 2', 'lon')}, {r('y', 'lat')} FROM (SELECT feature_id, y, i, xs[2 * i + 1] AS a, xs[2 * i + 2] AS b FROM (SELECT *, unnest(range(len(xs) // 2)) AS i FROM (SELECT feature_id, any_value(y) AS y, list_sort(list(x1 + (y - y1) * (x2 - x1) / (y2 - y1)) FILTER ((y1 > y) <> (y2 > y))) AS xs FROM (SELECT *, (min(y1) FILTER (ring = 0) OVER (PARTITION BY feature_id) + max(y1) FILTER (ring = 0) OVER (PARTITION BY feature_id)) / 2 AS y FROM edge) GROUP BY feature_id))) QUALIFY row_number() OVER (PARTITION BY feature_id ORDER BY b - a DESC, i) = 1",
    "progress_texts": f"SELECT page_id, format('Downloading — {{:.2f}} of {{:.2f}} GB', done_bytes / 1e9, total / 1e9) AS text, CASE WHEN v > 1e4 THEN format('{{:.0f}} MB/s', v / 1e6) END AS speed, {r('least(greatest(coalesce(done_bytes / nullif(total, 0), 0), 0), 1)', 'done')}, {r('least(greatest(1 - exp(-page_id / 100 / 3.4::DOUBLE), 0), 0.97)', 'progress')} FROM (SELECT page_id, strlen(html) * 90001 AS done_bytes, strlen(html) * 90001 + page_id * 1000003 AS total, (page_id * 97711 % 40000000)::DOUBLE AS v FROM pages)",
    "smoothed_speeds": f"SELECT user_id, {r('sum(list_reduce(v, lambda a, x: CASE WHEN a = 0 THEN x ELSE a * 0.75::DOUBLE + x * 0.25::DOUBLE END))', 'total')}, count(*) AS hours FROM (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id, date_trunc('hour', ts)) GROUP BY user_id",
    "upright_pixels": "SELECT image, (max(x) + 1)::INT AS width, (max(y) + 1)::INT AS height, sum(value * (1 + 100 * x + y))::BIGINT AS total FROM (SELECT image, value, CASE WHEN o IN (1, 4) THEN x WHEN o IN (2, 3) THEN 7 - x WHEN o IN (5, 8) THEN y ELSE h - 1 - y END AS x, CASE WHEN o IN (1, 2) THEN y WHEN o IN (3, 4) THEN h - 1 - y WHEN o IN (5, 6) THEN x ELSE 7 - x END AS y FROM (SELECT image, i // 32 AS y, i % 16 // 2 AS x, max((n + 31) // 32) AS h, max(image % 8 + 1) AS o, floor(avg(floor(128 + 100 * e)) + 0.5)::INT AS value FROM (SELECT vec_id AS image, len(v) AS n, unnest(v) AS e, generate_subscripts(v, 1) - 1 AS i FROM emb) GROUP BY ALL)) GROUP BY image",
    "image_sizes": "SELECT o_orderkey, step::INT AS step, CASE WHEN large > 512 THEN floor(a::FLOAT * (512::FLOAT / large::FLOAT) + 0.5::DOUBLE) ELSE a END::INT AS width, CASE WHEN large > 512 THEN floor(b::FLOAT * (512::FLOAT / large::FLOAT) + 0.5::DOUBLE) ELSE b END::INT AS height FROM (SELECT *, CASE WHEN turn THEN th ELSE tw END AS a, CASE WHEN turn THEN tw ELSE th END AS b, greatest(tw, th) AS large FROM (SELECT *, ceil(w / step)::INT AS tw, ceil(h / step)::INT AS th FROM (SELECT o_orderkey, o_orderkey * 37 % 6000 + 1 AS w, o_orderkey * 101 % 4500 + 1 AS h, o_orderkey % 8 + 1 IN (6, 8) AS turn, CASE WHEN greatest(w, h) // 512 >= 8 THEN 8 WHEN greatest(w, h) // 512 >= 4 THEN 4 WHEN greatest(w, h) // 512 >= 2 THEN 2 ELSE 1 END AS step FROM orders)))",
    "geojson_parts": f"SELECT name, (feature_id % 10)::INT AS part, count(*)::INT AS rings, sum(len(pts))::INT AS points, {r('sum(list_sum(list_transform(pts, lambda p: p.x + 2 * p.y)))', 'total')} FROM ring GROUP BY feature_id, name",
    "resized_images": "SELECT image, sum(value * (1 + 4 * y + x))::BIGINT AS total, round(avg(((value / 255::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE)::FLOAT::DOUBLE), 4) + 0 AS mean FROM (SELECT image, x, t AS y, least(greatest(floor(round(sum(w * value), 9) + 0.5::DOUBLE), 0), 255)::INT AS value FROM (SELECT image, y, t AS x, least(greatest(floor(round(sum(w * value), 9) + 0.5::DOUBLE), 0), 255)::INT AS value FROM pix JOIN halves ON s = x GROUP BY ALL) JOIN halves ON s = y GROUP BY ALL) GROUP BY image",
    "pca_covariance": "SELECT i, j, round(c, 9) + 0 AS covariance FROM cov",
    "whitened_lengths": "SELECT rid AS row, round(list_dot_product(y, list_transform(inv, lambda line: list_dot_product(line, y))), 5) AS length FROM (SELECT rid, list_transform(list_zip(v, m), lambda t: t[1] - t[2]) AS y FROM pv, (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(x) AS a FROM pdim GROUP BY i))) JOIN inverse ON true",
    "pca_moments": "SELECT i, round(avg(x), 6) + 0 AS mean, round(var_pop(x), 6) + 0 AS variance FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM pv) GROUP BY i",
}

SELECTS["label_points"] = f"SELECT name AS country, lon, lat FROM ({SELECTS['inner_points']}) JOIN (SELECT name, feature_id FROM (SELECT name, feature_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area FROM edge WHERE ring = 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY name ORDER BY area DESC, feature_id) = 1) USING (feature_id)"

SELECTS["map_file"] = f"""SELECT 'land' AS layer, (row_number() OVER (ORDER BY feature_id) - 1)::INT AS k, name, sum(len(pts))::INT AS n, round(sum(list_sum(list_transform(pts, lambda p: p.x + 2 * p.y))), 4) + 0 AS total,
    round((max(list_max(list_transform(pts, lambda p: p.x))) + 2e-4::DOUBLE)::FLOAT::DOUBLE - (min(list_min(list_transform(pts, lambda p: p.x))) - 2e-4::DOUBLE)::FLOAT::DOUBLE + 2 * ((max(list_max(list_transform(pts, lambda p: p.y))) + 2e-4::DOUBLE)::FLOAT::DOUBLE - (min(list_min(list_transform(pts, lambda p: p.y))) - 2e-4::DOUBLE)::FLOAT::DOUBLE), 4) + 0 AS box FROM ring GROUP BY feature_id, name
  UNION ALL SELECT 'labels', (i - 1)::INT, country, rank, round(round_even(lon * 1e6, 0) / 1e6::DOUBLE + 2 * (round_even(lat * 1e6, 0) / 1e6::DOUBLE), 4) + 0, NULL FROM (SELECT *, row_number() OVER (ORDER BY rank, pop DESC, country) AS i FROM (SELECT country, lon, lat, (n_nationkey % 10)::INT AS rank, n_nationkey * 1000 AS pop FROM ({SELECTS['label_points']}) JOIN nation ON n_name = country)) WHERE rank <= 6"""


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(text) for name, text in SELECTS.items()}
