"""The recipe of a place search: sizes, blend, gate, and the two linear models."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from waymark.scratch import write_bytes

#: The features of the reranker and of the confidence, in the order of their weights; fixed values.
RERANK_FEATURES = ("score", "raw", "log_rank", "margin", "cons10", "cons25", "cons50", "diffusion", "cc_mean", "cc_max3", "entropy", "fill", "score_cons25", "raw_cons25", "margin_cons25", "diffusion_cons25")
CONFIDENCE_FEATURES = ("agree10", "agree25", "agree100", "top_sim", "margin", "entropy", "log_candidates")


@dataclass(frozen=True)
class Linear:
    weights: tuple[float, ...]
    bias: float
    mean: tuple[float, ...]
    sd: tuple[float, ...]


@dataclass(frozen=True)
class Recipe:
    blend: dict[str, float] = field(default_factory=lambda: {"geo5c": 0.22, "geo10c": 0.22, "geo25c": 0.22, "cls_wh": 0.34})
    csls_spaces: tuple[str, ...] = ("geo5c", "geo10c", "geo25c")
    gate_mass: float = 0.95
    gate_cap: int = 400
    prior_lam: float = 0.05
    top_k: int = 100
    temperature: float = 0.05
    rerank: Linear | None = None
    rerank_lam: float = 2.0
    score_sd: float = 1.0
    confidence: Linear | None = None
    hit_km: float = 25.0


#: The keys of the file, as it spells them; fixed values, as are the defaults above.
SCHEMA = (
    "n_rows long, n_cells int, dim int, views_per_location int, spaces array<string>, csls_spaces array<string>, blend map<string,double>, gate_mass double, gate_cap int, "
    "prior_lam double, top_k int, e7_lam double, score_sd double, e7_w array<double>, e7_b double, e7_feat_mu array<double>, e7_feat_sd array<double>, "
    "conf_w array<double>, conf_b double, conf_mu array<double>, conf_sd array<double>, conf_hit_km double"
)


def read_recipe(spark: SparkSession, path: str) -> Recipe:
    """From a JSON file of one object. Without the keys of the confidence there is
    none; other missing keys have the defaults above."""
    row = spark.read.schema(SCHEMA).option("multiLine", True).json(path).first().asDict()
    base = Recipe()

    def linear(prefix: str, mean: str, sd: str) -> Linear | None:
        w = row[f"{prefix}_w"]
        return Linear(tuple(w), row[f"{prefix}_b"], tuple(row[mean]), tuple(row[sd])) if w else None

    def pick(key: str, default):  # noqa: ANN001, ANN202
        return default if row[key] is None else row[key]

    return Recipe(
        dict(pick("blend", base.blend)), tuple(pick("csls_spaces", base.csls_spaces)), pick("gate_mass", base.gate_mass), pick("gate_cap", base.gate_cap), pick("prior_lam", base.prior_lam),
        pick("top_k", base.top_k), base.temperature, linear("e7", "e7_feat_mu", "e7_feat_sd"), pick("e7_lam", base.rerank_lam), pick("score_sd", base.score_sd),
        linear("conf", "conf_mu", "conf_sd"), pick("conf_hit_km", base.hit_km),
    )


def _model(prefix: str, mean: str, sd: str, model: Linear | None) -> dict:
    return {} if model is None else {f"{prefix}_w": list(model.weights), f"{prefix}_b": model.bias, mean: list(model.mean), sd: list(model.sd)}


def recipe_object(recipe: Recipe, **index: object) -> dict:
    """The recipe under the file's keys, behind what describes the index (n_rows,
    n_cells, dim, views_per_location, spaces and the like); later keys win."""
    own = {
        "csls_spaces": list(recipe.csls_spaces), "blend": recipe.blend, "gate_mass": recipe.gate_mass, "gate_cap": recipe.gate_cap, "prior_lam": recipe.prior_lam,
        "top_k": recipe.top_k, "e7_lam": recipe.rerank_lam, "score_sd": recipe.score_sd,
    }
    confidence = _model("conf", "conf_mu", "conf_sd", recipe.confidence)
    return {**index, **own, **_model("e7", "e7_feat_mu", "e7_feat_sd", recipe.rerank), **confidence, **({"conf_hit_km": recipe.hit_km} if confidence else {})}


def write_json(spark: SparkSession, found: dict, path: str) -> None:
    """One object as a JSON file."""
    write_bytes(spark, json.dumps(found, indent=2).encode(), path)


def write_recipe(spark: SparkSession, recipe: Recipe, path: str, **index: object) -> None:
    """What read_recipe() reads back. Without a confidence model its keys are missing."""
    write_json(spark, recipe_object(recipe, **index), path)
