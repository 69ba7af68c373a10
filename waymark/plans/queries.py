"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.functions import geo
from waymark.functions.vector import dot
from waymark.operators import evaluate, fit, gate, images, index, orient, rerank, search, series, simplify, worldmap
from waymark.plans import fixture as X
from waymark.plans.fixture import RECIPE, table
from waymark.recipe import CONFIDENCE_FEATURES, RERANK_FEATURES
from waymark.scratch import scratch_path, written
from waymark.sources import assets, flatindex, geojson, mapfile


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*((F.round(F.col(f"`{f.name}`"), places) + 0.0).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema))


def rounded_many(df: DataFrame, places: int = 6) -> DataFrame:
    """As rounded(), for frames of very many rows: no decimal number is made of a value
    (what is too large for that, or no number, goes the other way)."""
    one = 10.0**places

    def near(x: Column) -> Column:
        return F.when(F.abs(x) < 1e9, F.signum(x) * F.floor(F.abs(x) * one + 0.5) / one).otherwise(F.round(x, places)) + 0.0

    return df.select(*(near(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema))


def long_spaces(rows: DataFrame, key: str) -> DataFrame:
    """(key, space, f) of rows with a column for each space."""
    return rows.select(key, F.explode(F.array(*(F.struct(F.lit(s).alias("space"), F.col(s).alias("f")) for s in X.SPACES))).alias("e")).select(key, "e.*")


def quantise_rows(s: SparkSession, d: str) -> DataFrame:
    p = X.places(s, d)
    out = p.select("row", F.explode(F.array(*(F.struct(F.lit(n).alias("space"), F.col(n).alias("code"), F.col(f"{n}_scale").alias("scale")) for n in X.SPACES))).alias("e")).select("row", "e.*")
    total = F.aggregate("code", F.lit(0).cast("long"), lambda a, x: a + x)
    checksum = F.aggregate(F.transform("code", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("row", "space", F.round("scale", 9).alias("scale"), total.alias("total"), checksum.alias("checksum"))


def simplified_borders(s: SparkSession, d: str) -> DataFrame:
    """The map with a tolerance of two and a half degrees: points and area of each ring."""
    rings = simplify.simplified(X.features_of_nations(s, d), 2.5, square=5.0).select("feature_id", F.posexplode("rings").alias("ring", "points"))
    return rounded(rings.select("feature_id", "ring", F.size("points").alias("n"), worldmap.ring_area(F.col("points")).alias("area")))


def flat_index(s: SparkSession, d: str) -> DataFrame:
    """The index, written as flat files and read from them: where each row is, and sums of what it holds."""
    p = X.places(s, d)
    path = scratch_path(s, "flat_index")
    at = flatindex.write_flat_index(p, path, X.SPACES, X.N_CELLS).select(F.col("row").alias("place"), F.col("at").alias("row"))
    back = flatindex.FlatIndex(s, path, X.SPACES).read()
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    sums = {n: total(F.transform(n, lambda x, i: x.cast("long") * (i + 1))) for n in X.SPACES}
    return back.join(at, "row").select("row", "place", "cell", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), F.size("csls").alias("spaces"), F.round("cls_scale", 6).alias("scale"), *(c.alias(n) for n, c in sums.items()))


def dequant_dot(s: SparkSession, d: str) -> DataFrame:
    q, cells = written(X.query_vectors(s, d).withColumnRenamed("v", "cls"), "queries"), written(X.gated(s, d), "gated")
    return rounded_many(search.dequantised_in_blocks(q, cells, X.places(s, d), "cls", "product"))


def l2_normalise(s: SparkSession, d: str) -> DataFrame:
    rows = long_spaces(X.queries(s, d), "qid")
    return rounded(rows.select("qid", "space", F.col("f")[0].alias("first"), F.aggregate("f", F.lit(0.0), lambda a, x: a + x).alias("total"), dot(F.col("f"), F.col("f")).alias("length")))


def csls_topk_mean(s: SparkSession, d: str) -> DataFrame:
    each = F.posexplode("csls").alias("i", "csls")
    names = F.array(*map(F.lit, RECIPE.csls_spaces))
    return rounded(X.csls_rows(X.float_places(s, d)).select("row", each).select("row", names[F.col("i")].alias("space"), "csls"))


def blend_score(s: SparkSession, d: str) -> DataFrame:
    q, cells = written(X.queries(s, d), "queries"), written(X.gated(s, d), "gated")
    return rounded_many(search.scored_in_blocks(q, cells, X.places(s, d), RECIPE))


def topk_candidates(s: SparkSession, d: str, k: int = RECIPE.top_k) -> DataFrame:
    q, cells = written(X.queries(s, d), "queries"), written(X.gated(s, d), "gated")
    return rounded(search.best(q, cells, X.whole_index(s, d), replace(RECIPE, top_k=k)).select("qid", "row", "rank", "s"))


def nearest_places(s: SparkSession, d: str) -> DataFrame:
    return rounded(search.nearest(X.truth(s, d), X.float_places(s, d), 5))


def pairs(s: SparkSession, d: str) -> DataFrame:
    return rerank.pairs(rerank.weights(X.best(s, d)[0], RECIPE.temperature))


def per_candidate(*columns) -> object:  # noqa: ANN002
    return lambda s, d: rounded(pairs(s, d).groupBy("qid", "row").agg(*(c() for c in columns)))


def score_entropy(s: SparkSession, d: str) -> DataFrame:
    w = rerank.weights(X.best(s, d)[0], RECIPE.temperature)
    return rounded(w.groupBy("qid").agg(F.count("*").alias("k"), rerank.entropy(F.col("w")).alias("entropy")))


def rerank_features(s: SparkSession, d: str) -> DataFrame:
    return rounded(rerank.features(X.best(s, d)[0], RECIPE).select("qid", "row", "rank", *RERANK_FEATURES))


def locate(s: SparkSession, d: str) -> DataFrame:
    rows, counts, one = X.final_rows(s, d)
    cells = counts.select("qid", "gate_cells")
    where = rows.where("place = 0").select("qid", "lat", "lon")
    return rounded(one.join(where, "qid").join(cells, "qid").select("qid", "row", "lat", "lon", "n_candidates", "gate_cells", "s", "final", "confidence"))


def error_report(s: SparkSession, d: str) -> DataFrame:
    t = X.truth(s, d).select("qid", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    rows = X.final_rows(s, d)[0].where("place = 0").join(t, "qid")
    return rounded(evaluate.error_report(rows.select(geo.haversine_km(F.col("lat2"), F.col("lon2"), F.col("lat"), F.col("lon")).alias("km"))))


def settlements(s: SparkSession, d: str) -> DataFrame:
    return X.settlements(s, d).withColumn("rank", worldmap.clamp_rank(F.col("scalerank")))


def place_flags(s: SparkSession, d: str) -> DataFrame:
    flags = worldmap.place_flags(F.col("featurecla"), F.col("adm0cap"), F.col("megacity"), F.col("worldcity"))
    return settlements(s, d).select("name", flags.alias("flags"), "rank", worldmap.clamp_rank(F.col("labelrank"), worldmap.NO_LABEL_RANK, 255).alias("label_rank"))


def place_cut(s: SparkSession, d: str) -> DataFrame:
    """The places as features of a collection, and those of them that a map shows."""
    k = F.regexp_extract("name", "([0-9]+)$", 1).cast("long")
    named = F.when(k % 19 == 0, F.lit(None)).when(k % 19 == 1, "  ").otherwise(F.concat(F.lit(" "), F.col("name")))
    properties = F.struct(named.alias("NAME"), F.when(k % 19 == 1, F.col("name")).alias("NAMEASCII"), F.col("scalerank").alias("SCALERANK"), F.col("pop_max").alias("POP_MAX"))
    kind = F.when(k % 23 == 0, "LineString").otherwise("Point")
    at = F.to_json(F.struct(kind.alias("type"), F.array(k % 180 / 1.0, k % 90 / 1.0).alias("coordinates")))
    shown = geojson.settlements(X.settlements(s, d).select(F.to_json(properties).alias("properties"), kind.alias("type"), at.alias("geometry")), 8)
    return rounded(shown.select("name", worldmap.clamp_rank(F.col("scalerank")).alias("rank"), "pop_max", "lon", "lat"))


def polygon_area_filter(s: SparkSession, d: str) -> DataFrame:
    parts = X.features_of_nations(s, d).select(F.col("name").alias("country"), F.col("feature_id").alias("part"), F.col("rings")[0].alias("ring"))
    return rounded(worldmap.large_parts(parts, 600.0).select("country", "part", "area"))


def map_difference(s: SparkSession, d: str) -> DataFrame:
    old = settlements(s, d).select("name", "rank", "pop_max")
    new = old.where(~F.col("name").endswith("1")).withColumn("pop_max", F.when(F.col("name").endswith("2"), F.col("pop_max") + 1).otherwise(F.col("pop_max")))
    return worldmap.difference(old, new, ["name"], ["rank", "pop_max"])


def homonyms(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    names = table(s, d, "supplier").select(F.when(k % 2 == 0, F.col("s_name")).otherwise(F.concat(F.substring("s_name", 1, 5), F.lit("?"))).alias("asked"))
    return worldmap.named_place(names, settlements(s, d).na.fill({"pop_max": 0}))


def on_points(*columns) -> object:  # noqa: ANN002
    return lambda s, d: rounded(X.points(s, d).select("point_id", *(c() for c in columns)))


def project_to_screen(s: SparkSession, d: str) -> DataFrame:
    lit = F.lit
    xy = geo.project(F.col("lat"), F.col("lon"), lit(10.0), lit(20.0), lit(6.0), lit(1080.0), lit(1920.0))
    near = X.points(s, d).withColumn("xy", xy).where("xy is not null")
    return rounded(near.select("point_id", "xy.x", "xy.y"))


def scale_bar(s: SparkSession, d: str) -> DataFrame:
    k = geo.km_per_pixel(F.col("lat"), (1 + F.col("point_id") % 900).cast("double"))
    return rounded(X.points(s, d).withColumn("k", k).select("point_id", geo.scale_bar_km(F.col("k")).alias("km"), geo.scale_bar_px(F.col("k")).alias("px")))


def parity_report(s: SparkSession, d: str) -> DataFrame:
    k = F.col("point_id")
    a = X.points(s, d).select(k.alias("file"), "lat", "lon", k.alias("top_row"))
    b = X.points(s, d).where(k % 3 != 0).select(k.alias("file"), (F.col("lat") + 0.001).alias("lat"), "lon", F.when(k % 97 != 0, k).otherwise(-1).alias("top_row"), (k * 13 % 700).alias("ms"))
    return rounded(evaluate.parity(a, b))


def bench_median(s: SparkSession, d: str) -> DataFrame:
    return rounded(evaluate.latency(table(s, d, "events"), "event_type", "value"))


def format_km(s: SparkSession, d: str) -> DataFrame:
    return X.scored_answers(s, d).select("qid", geo.format_km((F.col("qid") % 4001) * 0.37 + 0.0012).alias("text"))


def manifest(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").select("page_id", F.col("url").alias("path"), F.octet_length("html").cast("long").alias("bytes"))


def listing(s: SparkSession, d: str) -> DataFrame:
    return manifest(s, d).where("page_id % 5 <> 0").select("path", (F.col("bytes") + (F.col("page_id") % 7 == 0).cast("long")).alias("bytes"))


def manifest_hashes(s: SparkSession, d: str) -> DataFrame:
    return assets.hashed(table(s, d, "pages").select(F.col("url").alias("path"), F.col("html").cast("binary").alias("content")))


def view_select(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("row"), "l_quantity")
    return index.one_view(rows).groupBy("row").agg(F.sum("l_quantity").alias("total"))


def download_text(s: SparkSession, d: str) -> DataFrame:
    speed = (F.col("page_id") * 977 % 400000 + 1).cast("double")
    return table(s, d, "pages").select("page_id", geo.time_left(F.octet_length("html") * 9000, speed).alias("text"))


def shard_order(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select(F.concat(F.lit("c2_cls_r"), (F.col("o_custkey") % 12).cast("string")).alias("file"), F.col("o_orderkey").alias("i"))
    return assets.numbered(rows, "file", "i").select("shard", "i", "row")


def layer_union(s: SparkSession, d: str) -> DataFrame:
    labels = table(s, d, "nation").select(F.lit("countries").alias("layer"), (F.col("n_nationkey") % 8).cast("int").alias("rank"))
    both = settlements(s, d).select(F.lit("places").alias("layer"), "rank").unionByName(labels)
    return both.groupBy("layer").agg(F.count("*").alias("n"), F.sum("rank").alias("ranks"))


def layer_names_removed(s: SparkSession, d: str) -> DataFrame:
    nations = table(s, d, "nation")
    return nations.select(F.col("n_name").alias("name")).subtract(nations.where("n_regionkey > 1").select("n_name"))


def pca_moments(s: SparkSession, d: str) -> DataFrame:
    mean, square = index.covariance(X.place_vectors(s, d))
    rows = [(i, float(m), float(v)) for i, (m, v) in enumerate(zip(mean, square.diagonal()), 1)]
    return rounded(s.createDataFrame(rows, "i long, mean double, variance double"))


def pca_covariance(s: SparkSession, d: str) -> DataFrame:
    """The whole covariance that the whitening is made from."""
    square = index.covariance(X.place_vectors(s, d))[1]
    rows = [(i, j, float(x)) for i, row in enumerate(square, 1) for j, x in enumerate(row, 1)]
    return rounded(s.createDataFrame(rows, "i long, j long, covariance double"), 9)


def whitened_lengths(s: SparkSession, d: str) -> DataFrame:
    """Squared lengths of the whitened places: the same for any choice of eigenvectors."""
    rows = X.place_vectors(s, d)
    v = F.col("cls_wh")
    return index.whitened(rows, *index.whitening(rows), unit=False).select("row", F.round(dot(v, v), 5).alias("length"))


def standardising(rows: DataFrame, names: list[str]) -> tuple[list[float], list[float]]:
    stats = {r.feature: r for r in fit.moments(rows, names).collect()}
    return [stats[n].mean for n in names], [stats[n].sd for n in names]


def rerank_models(s: SparkSession, d: str) -> DataFrame:
    """The reranker fitted by gradient descent, for each of five folds and for all."""
    rows = training_rows(s, d)
    names = list(RERANK_FEATURES)
    return rounded(fit.fit(rows, names, *standardising(rows, names)).select("fold", F.posexplode("w").alias("i", "w"), "b"))


def confidence_rows(s: SparkSession, d: str) -> DataFrame:
    """(qid, km, y, fold, the confidence's features) of the answers."""
    rows, _, one = X.final_rows(s, d)
    t = X.truth(s, d).select("qid", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    km = geo.haversine_km(F.col("lat2"), F.col("lon2"), F.col("lat"), F.col("lon"))
    near = rows.where("place = 0").join(t, "qid").select("qid", km.alias("km"))
    given = one.select("qid", *CONFIDENCE_FEATURES).join(near, "qid").withColumn("fold", (F.floor(F.col("qid") / 10) % 5).cast("int"))
    return written(given.withColumn("y", (F.col("km") <= RECIPE.hit_km).cast("int")), "confidence_rows")


def confidence_models(s: SparkSession, d: str) -> DataFrame:
    """The confidence fitted by gradient descent, for each of five folds and for all."""
    rows = confidence_rows(s, d)
    names = list(CONFIDENCE_FEATURES)
    return rounded(fit.fit(rows, names, *standardising(rows, names), **fit.CONFIDENCE_FIT).select("fold", F.posexplode("w").alias("i", "w"), "b"))


def confidence_cv(s: SparkSession, d: str) -> DataFrame:
    """What the confidence states of answers that its fit has not seen."""
    rows = confidence_rows(s, d)
    names = list(CONFIDENCE_FEATURES)
    mean, sd = standardising(rows, names)
    found = fit.with_probability(fit.out_of_fold(rows, fit.fit(rows, names, mean, sd, **fit.CONFIDENCE_FIT), names, mean, sd))
    return rounded(found.select("qid", "y", "p"))


def training_rows(s: SparkSession, d: str) -> DataFrame:
    top = X.best(s, d)[0]
    t = X.truth(s, d).select("qid", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    km = geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    near = top.join(t, "qid").select("qid", "row", km.alias("km"))
    rows = rerank.features(top, RECIPE).join(near, ["qid", "row"])
    rows = rows.withColumn("fold", (F.floor(F.col("qid") / 10) % 5).cast("int")).withColumn("y", (F.col("km") <= RECIPE.hit_km).cast("int"))
    return written(rows, "training_rows")


def lambda_grid(s: SparkSession, d: str) -> DataFrame:
    rows = training_rows(s, d)
    names = list(RERANK_FEATURES)
    mean, sd = standardising(rows, names)
    scored = fit.out_of_fold(rows, fit.fit(rows, names, mean, sd), names, mean, sd)
    return rounded(fit.best_lambda(scored, [0.5, 1.0, 2.0], RECIPE.score_sd))


def whitened_rows(s: SparkSession, d: str) -> DataFrame:
    rows = X.place_vectors(s, d)
    return rounded(index.whitened(rows, *index.whitening(rows)).select("row", F.col("cls_wh")[0].alias("first"), dot(F.col("cls_wh"), F.col("cls_wh")).alias("length")))


def layers(s: SparkSession, d: str) -> DataFrame:
    nations = table(s, d, "nation").select(F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("layer"), F.substring("n_name", 1, 1).alias("name"))
    return nations.unionByName(settlements(s, d).select(F.lit("places").alias("layer"), "name"))


def map_features(s: SparkSession, d: str) -> DataFrame:
    """The nations' features in three layers, numbered within each, with boxes."""
    rows = X.features_of_nations(s, d).drop("min_lon", "max_lon", "min_lat", "max_lat")
    key = F.floor(F.col("feature_id") / 10)
    rows = worldmap.boxes(rows, 0.0).withColumn("layer", F.concat(F.lit("l"), (key % 3).cast("string"))).withColumn("kind", F.lit(0))
    return rows.withColumn("k", F.floor(key / 3).cast("long") * 2 + F.col("feature_id") % 10)


def geometry_difference(s: SparkSession, d: str) -> DataFrame:
    old = map_features(s, d)
    key = F.floor(F.col("feature_id") / 10)
    new = old.where((F.col("layer") != "l2") | (key != 2)).withColumn("name", F.when(key == 3, "X").otherwise(F.col("name")))
    new = new.withColumn("max_lon", F.when(key == 7, F.col("max_lon") + 1).otherwise(F.col("max_lon")))
    turned = F.transform("rings", lambda r: F.reverse(r))
    new = new.withColumn("rings", F.when(key == 9, turned).otherwise(F.col("rings")))
    extra = old.where(key == 0).withColumn("layer", F.lit("new"))
    return worldmap.geometry_difference(old.unionByName(old.where(key == 1).withColumn("layer", F.lit("old"))), new.unionByName(extra))


def run_drift(s: SparkSession, d: str) -> DataFrame:
    a = X.query_vectors(s, d).withColumn("cell", (F.col("qid") % 7).cast("int"))
    b = a.select("qid", F.transform("v", lambda x: F.round(x, 2)).alias("v"), F.when(F.col("qid") % 11 == 0, -1).otherwise(F.col("cell")).alias("cell"))
    return rounded(index.drift(a, b))


def ring_repeats(s: SparkSession, d: str) -> DataFrame:
    """Rings whose points are repeated by a rule, and what is left of them."""
    rows = X.features_of_nations(s, d).select("feature_id", F.posexplode("rings").alias("ring", "pts"))
    twice = F.flatten(F.transform("pts", lambda p, i: F.when((i + F.col("feature_id")) % 2 == 0, F.array(p, p)).otherwise(F.array(p))))
    kept = worldmap.without_repeats(F.concat(twice, F.slice("pts", 1, 1)))
    total = F.aggregate(kept, F.lit(0.0), lambda a, p: a + p["lon"] + 2 * p["lat"])
    return rounded(rows.select("feature_id", "ring", F.size(kept).alias("n"), total.alias("total")))


def usable_rings(s: SparkSession, d: str) -> DataFrame:
    """Outlines and holes that are cut short by a rule."""
    cut = F.transform("rings", lambda r, i: F.when((F.col("feature_id") / 10 + i) % 4 < 1, F.slice(r, 1, 2)).otherwise(r))
    return worldmap.usable_rings(X.features_of_nations(s, d).withColumn("rings", cut)).select("feature_id", F.size("rings").alias("rings"))


def clean_names(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    first = F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, "   ").otherwise(F.concat(F.lit("  "), F.col("s_name"), F.lit(" ")))
    second = F.when(k % 5 != 0, F.concat(F.lit(" alt"), k.cast("string")))
    return table(s, d, "supplier").select("s_suppkey", worldmap.clean_name(first, second).alias("name"))


def smoothed_speeds(s: SparkSession, d: str) -> DataFrame:
    """Each user's values of an hour in order of time, smoothed."""
    rows = table(s, d, "events").select("user_id", F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", "value")
    last = series.smoothed_rows(rows, ["user_id", "hour"], ["ts", "event_id"], "value").groupBy("user_id", "hour").agg(F.max_by("smoothed", F.struct("ts", "event_id")).alias("last"))
    return rounded(last.groupBy("user_id").agg(F.sum("last").alias("total"), F.count("*").alias("hours")))


def label_points(s: SparkSession, d: str) -> DataFrame:
    """Where the nations' names are written."""
    parts = X.features_of_nations(s, d).select(F.col("name").alias("country"), F.col("feature_id").alias("part"), "rings")
    return rounded(worldmap.label_points(parts))


def upright_pixels(s: SparkSession, d: str) -> DataFrame:
    """The embeddings as images of sixteen columns in all orientations, made upright and small."""
    rows = X.vectors(s, d).select(F.col("vec_id").alias("image"), "v")
    pixels = rows.select("image", F.posexplode("v").alias("i", "x")).select("image", F.floor(F.col("i") / 16).cast("int").alias("y"), (F.col("i") % 16).alias("x"), F.lit(0).alias("c"), F.floor(128 + 100 * F.col("x")).cast("int").alias("value"))
    sizes = rows.select("image", F.lit(16).alias("width"), F.ceil(F.size("v") / 16).cast("int").alias("height"), (F.col("image") % 8 + 1).cast("int").alias("orientation"))
    done = orient.prepared(pixels, sizes, side=8, mirrors=True)
    total = F.sum(F.col("value") * (1 + 100 * F.col("x") + F.col("y"))).cast("long")
    return done.groupBy("image").agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"), total.alias("total"))


def image_sizes(s: SparkSession, d: str) -> DataFrame:
    """What becomes of images of sizes made from the orders."""
    k = F.col("o_orderkey")
    w, h, o = (k * 37 % 6000 + 1).cast("int"), (k * 101 % 4500 + 1).cast("int"), (k % 8 + 1).cast("int")
    return table(s, d, "orders").select("o_orderkey", orient.thinning(w, h).alias("step"), orient.final_size(w, h, o).alias("to")).select("o_orderkey", "step", "to.width", "to.height")


def geojson_parts(s: SparkSession, d: str) -> DataFrame:
    """The nations as collections of polygons, one file for each region, read back part by part."""
    path = scratch_path(s, "collections")
    pairs = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"])))
    nations = X.features_of_nations(s, d).select("name", F.struct("feature_id", pairs.alias("r")).alias("part")).groupBy("name").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    shape = lambda kind, rings: F.to_json(F.struct(F.lit(kind).alias("type"), rings.alias("coordinates")))
    geometry = F.when(F.size("parts") > 1, shape("MultiPolygon", F.transform("parts", lambda p: p["r"]))).otherwise(shape("Polygon", F.col("parts")[0]["r"]))
    feature = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(F.col("name").alias("NAME"))), F.lit(',"geometry":'), geometry, F.lit("}"))
    regions = table(s, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    text = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.collect_list(feature)), F.lit("]}"))
    nations.join(regions, "name").groupBy("region").agg(text.alias("value")).write.partitionBy("region").text(path)
    points = F.flatten("rings")
    total = F.aggregate(points, F.lit(0.0), lambda a, p: a + p["lon"] + 2 * p["lat"])
    back = geojson.parts(geojson.read_collection(s, path))
    return rounded(back.select(F.get_json_object("properties", "$.NAME").alias("name"), "part", F.size("rings").alias("rings"), F.size(points).alias("points"), total.alias("total")))


def map_file(s: SparkSession, d: str) -> DataFrame:
    """The nations and their names' places as one binary map, read back: boxes and points of
    the outlines, places up to a rank. No rule of the format is broken, or its name is a row."""
    path = scratch_path(s, "world") + ".bin"
    land = X.features_of_nations(s, d).select(F.lit("land").alias("layer"), F.lit("polygon").alias("kind"), "feature_id", "name", "rings")
    k = F.col("n_nationkey")
    at = label_points(s, d).join(table(s, d, "nation"), F.col("country") == F.col("n_name"))
    names = at.select(F.lit("labels").alias("layer"), F.col("n_name").alias("name"), "lon", "lat", (k * 1000).cast("long").alias("pop_max"), "country", (k % 10).cast("int").alias("rank"), F.lit(0).alias("flags"), F.lit(1).alias("label_rank"))
    mapfile.write_map(land, names, path)
    points = F.flatten("rings")
    total = F.aggregate(points, F.lit(0.0), lambda a, p: a + p["lon"] + 2 * p["lat"])
    features = mapfile.map_table(s, path).select("layer", F.col("feature_id").alias("k"), "name", F.size(points).alias("n"), total.alias("total"), (F.col("max_lon") - F.col("min_lon") + 2 * (F.col("max_lat") - F.col("min_lat"))).alias("box"))
    none = F.lit(None).cast("double")
    places = mapfile.map_table(s, path, "places").where("rank <= 6").select("layer", F.col("place_id").alias("k"), "name", "rank", (F.col("lon") + 2 * F.col("lat")).alias("total"), none.alias("box"))
    wrong = mapfile.map_problems(s, path).select("layer", F.col("feature").alias("k"), F.col("rule").alias("name"), F.lit(0).alias("n"), none.alias("total"), none.alias("box"))
    return rounded(features.union(places).union(wrong), 4)


def resized_images(s: SparkSession, d: str) -> DataFrame:
    """The embeddings as images of eight by eight pixels, made half as large."""
    value = F.least(F.greatest(F.floor(128 + 100 * F.col("x")), F.lit(0)), F.lit(255)).cast("int")
    pixels = X.vectors(s, d).select(F.col("vec_id").alias("image"), F.posexplode("v").alias("i", "x")).select("image", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.lit(0).alias("c"), value.alias("value"))
    small = images.resized(pixels, 8, 8, 4)
    order = 1 + 4 * F.col("y") + F.col("x")
    sums = small.groupBy("image").agg(F.sum(F.col("value") * order).cast("long").alias("total"))
    tensor = images.tensors(images.normalised(small))
    mean = F.aggregate("tensor", F.lit(0.0), lambda a, x: a + x) / F.size("tensor")
    return sums.join(tensor.select("image", F.round(mean, 4).alias("mean")), "image")


def progress_texts(s: SparkSession, d: str) -> DataFrame:
    done = F.octet_length("html").cast("long") * 90001
    total, speed = done + F.col("page_id") * 1000003, (F.col("page_id") * 97711 % 40000000).cast("double")
    return rounded(table(s, d, "pages").select(
        "page_id", geo.progress_text(done, total).alias("text"), geo.speed_text(speed).alias("speed"), geo.fraction_done(done, total).alias("done"), geo.saturating_progress(F.col("page_id") / 100.0).alias("progress"),
    ))


def queries() -> dict:
    return {
        "locate_flagship": locate,
        "quantise_rows": quantise_rows,
        "flat_index": flat_index,
        "dequant_dot": dequant_dot,
        "l2_normalise": l2_normalise,
        "softmax_posterior": lambda s, d: rounded(gate.posterior(X.logits(s, d))),
        "gate_mass": lambda s, d: rounded(X.gated(s, d)),
        "gate_cap": lambda s, d: rounded(X.gated(s, d, cap=3)),
        "cell_assign": lambda s, d: index.assign_cells(X.place_vectors(s, d), X.centroids(s, d)),
        "cell_histogram_offsets": lambda s, d: index.cell_offsets(index.assign_cells(X.place_vectors(s, d), X.centroids(s, d)), X.N_CELLS),
        "csls_topk_mean": csls_topk_mean,
        "prior_term": lambda s, d: rounded(X.gated(s, d).select("qid", "cell", gate.log_prior(F.col("p"), RECIPE.prior_lam).alias("prior"))),
        "blend_score": blend_score,
        "topk_candidates": topk_candidates,
        "topk_20": lambda s, d: topk_candidates(s, d, 20),
        "nearest_places_by_haversine": nearest_places,
        "pair_affinity": per_candidate(lambda: F.count(F.when(F.col("cc") > rerank.ALIKE, 1)).alias("alike"), lambda: F.sum(F.when(F.col("cc") > rerank.ALIKE, F.col("cc")).otherwise(0.0)).alias("affinity"), lambda: F.max("km").alias("furthest")),
        "consensus_weights": lambda s, d: rounded(rerank.weights(X.best(s, d)[0], RECIPE.temperature).select("qid", "row", "w")),
        "consensus_radius": per_candidate(lambda: rerank.within(10).alias("cons10"), lambda: rerank.within(25).alias("cons25"), lambda: rerank.within(50).alias("cons50")),
        "ccmean": per_candidate(lambda: rerank.cc_mean().alias("cc_mean")),
        "ccmax3": per_candidate(lambda: F.coalesce(rerank.cc_max3(), F.lit(0.0)).alias("cc_max3")),
        "affinity_diffusion": per_candidate(lambda: rerank.diffusion().alias("diffusion")),
        "score_entropy": score_entropy,
        "rerank_features": rerank_features,
        "rerank_linear_score": lambda s, d: rounded(X.final_rows(s, d)[0].select("qid", "row", "e7")),
        "final_rank": lambda s, d: rounded(X.final_rows(s, d)[0].select("qid", "row", "place", "final")),
        "confidence": lambda s, d: rounded(X.final_rows(s, d)[2].select("qid", "agree10", "agree25", "agree100", "top_sim", "margin", "entropy", "log_candidates", "confidence")),
        "spread_top12": lambda s, d: rounded(rerank.spread_degrees(X.final_rows(s, d)[0])),
        "error_report": error_report,
        "simplified_borders": simplified_borders,
        "point_in_polygon": lambda s, d: worldmap.containing(X.points(s, d), X.nation_index(s, d)),
        "nearest_coast_snap": lambda s, d: rounded(worldmap.nearest_coast(X.points(s, d).join(worldmap.containing(X.points(s, d), X.nation_index(s, d)), "point_id", "left_anti"), X.features_of_nations(s, d))),
        "country_at": lambda s, d: rounded(worldmap.country_at(X.points(s, d), X.nation_index(s, d))),
        "mercator_roundtrip": on_points(lambda: geo.mercator_y(F.col("lat") * 1.3).alias("y"), lambda: geo.mercator_lat(geo.mercator_y(F.col("lat") * 1.3)).alias("lat")),
        "format_latlon": on_points(lambda: geo.format_lat_lon(F.col("lat"), F.col("lon")).alias("text")),
        "format_km": format_km,
        "rank_prefix": lambda s, d: settlements(s, d).where("rank <= 6").select("name", "rank", F.coalesce("pop_max", F.lit(0)).alias("pop_max")).orderBy(*worldmap.place_order()),
        "rank_index": lambda s, d: worldmap.rank_index(settlements(s, d)),
        "place_flags": place_flags,
        "polygon_area_filter": polygon_area_filter,
        "feature_boxes": lambda s, d: rounded(worldmap.boxes(X.features_of_nations(s, d).select("feature_id", "rings")).drop("rings")),
        "map_difference": map_difference,
        "homonym_lookup": homonyms,
        "coordinate_quantise": on_points(lambda: geo.quantise_degrees(F.col("lat")).alias("lat_q"), lambda: geo.quantise_degrees(F.col("lon") * 1.1).alias("lon_q")),
        "wrap_longitude": on_points(lambda: geo.wrap_lon(F.col("lon") * 7.3).alias("lon")),
        "spread_zoom": on_points(lambda: geo.spread_zoom(F.abs(F.col("lon")) / 10, F.col("lat"), F.lit(1080.0), F.lit(1920.0)).alias("zoom")),
        "project_to_screen": project_to_screen,
        "scale_bar": scale_bar,
        "zoom_ranks": on_points(lambda: geo.country_rank_at(F.col("point_id") * 7 % 6000 / F.lit(10.0)).alias("country_rank"), lambda: geo.place_rank_at(F.col("point_id") * 7 % 6000 / F.lit(10.0)).alias("place_rank")),
        "brier_auc": lambda s, d: rounded(evaluate.brier_auc(X.scored_answers(s, d))),
        "calibration_bins": lambda s, d: rounded(evaluate.calibration(X.scored_answers(s, d))),
        "confidence_bands": lambda s, d: rounded(evaluate.bands(X.scored_answers(s, d))),
        "confidence_texts": lambda s, d: X.scored_answers(s, d).select("qid", geo.confidence_text(F.col("p")).alias("text"), geo.confidence_tier(F.col("p")).alias("tier")),
        "signal_tiers": lambda s, d: rounded(evaluate.tiers(X.scored_answers(s, d), "p")),
        "parity_report": parity_report,
        "bench_median": bench_median,
        "fold_assign": lambda s, d: X.scored_answers(s, d).groupBy((F.col("qid") % 5).alias("fold")).agg(F.count("*").alias("n"), F.sum("y").alias("hits")),
        "feature_moments": lambda s, d: rounded(fit.moments(X.scored_answers(s, d), ["p", "km"])),
        "manifest_todo_anti": lambda s, d: assets.to_do(manifest(s, d).select("path", "bytes"), listing(s, d)),
        "manifest_mismatch": lambda s, d: assets.mismatched(manifest(s, d).select("path", "bytes"), listing(s, d)),
        "manifest_hashes": manifest_hashes,
        "view_select": view_select,
        "download_text": download_text,
        "shard_order": shard_order,
        "layer_union": layer_union,
        "layer_names_removed": layer_names_removed,
        "pca_moments": pca_moments,
        "pca_covariance": pca_covariance,
        "whitened_lengths": whitened_lengths,
        "rerank_models": rerank_models,
        "lambda_grid": lambda_grid,
        "whitened_rows": whitened_rows,
        "confidence_models": confidence_models,
        "confidence_cv": confidence_cv,
        "score_sd": lambda s, d: rounded(fit.score_sd(X.best(s, d)[0])),
        "names_per_layer": lambda s, d: worldmap.names_per_layer(layers(s, d)),
        "manifest_totals": lambda s, d: assets.totals(manifest(s, d).select("path", "bytes"), listing(s, d)),
        "head_rows": lambda s, d: assets.head(table(s, d, "customer"), ["c_custkey"], 32).select("i", "c_custkey", "c_name"),
        "geometry_difference": geometry_difference,
        "place_cut": place_cut,
        "unit_xyz": on_points(lambda: geo.unit_xyz(F.col("lat"), F.col("lon"))[0].alias("x"), lambda: geo.unit_xyz(F.col("lat"), F.col("lon"))[1].alias("y"), lambda: geo.unit_xyz(F.col("lat"), F.col("lon"))[2].alias("z")),
        "usable_rings": usable_rings,
        "ring_repeats": ring_repeats,
        "run_drift": run_drift,
        "clean_names": clean_names,
        "northing_limit": on_points(lambda: geo.northing_limit(F.col("point_id") % 12 / F.lit(1.0), F.lit(1080.0), F.lit(1920.0)).alias("limit")),
        "image_numbers": lambda s, d: table(s, d, "pages").select("page_id", assets.image_number(F.concat(F.when(F.col("page_id") % 4 == 0, "val-").otherwise("val_"), F.lpad((F.col("page_id") % 9000).cast("string"), 4, "0"), F.lit(".jpg"))).alias("i")),
        "inner_points": lambda s, d: rounded(X.features_of_nations(s, d).select("feature_id", worldmap.inner_point(F.col("rings")).alias("p")).select("feature_id", "p.lon", "p.lat")),
        "label_points": label_points,
        "geojson_parts": geojson_parts,
        "map_file": map_file,
        "resized_images": resized_images,
        "upright_pixels": upright_pixels,
        "image_sizes": image_sizes,
        "progress_texts": progress_texts,
        "smoothed_speeds": smoothed_speeds,
    }
