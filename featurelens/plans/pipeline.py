"""End-to-end fits: profile, select, train, compare, choose, save."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from featurelens.operators import binary_metrics as BM, models as M, regression_metrics as RM, selection as S, tune
from featurelens.operators.balance import oversample, smote
from featurelens.operators.clusters import profile_clusters
from featurelens.operators.explain import mean_attribution, shapley
from featurelens.operators.tree_attribution import TREES, tree_attribution
from featurelens.operators.dbscan import NOISE
from featurelens.operators.density import fit_density_model
from featurelens.operators.columns import clean_numeric_target, clustering_columns, column_facts
from featurelens.operators.profile import class_distribution, detect_imbalance, full_profile, tag_datasets
from featurelens.operators.select import audit_trail, select_features
from featurelens.operators.shared import local_frame, pin_small
from featurelens.operators.split import clustering_split, train_valid_test, with_folds, with_split
from featurelens.operators.transform import (
    Preprocessor, build_preprocessing, encoded_frame, fit_preprocessor, with_label,
)
from featurelens.sources.writers import save_model


@dataclass(frozen=True)
class FitConfig:
    """Options of the three fits."""
    models: tuple[str, ...] = ()
    params: dict = field(default_factory=dict)          # model name -> estimator parameters
    train_size: float = 0.7
    valid_size: float = 0.2
    seed: int = 12345
    max_features: int = 30
    missing_threshold: float = 0.75
    max_categories: int = 50
    exclude: tuple[str, ...] = ()
    auto_balance: bool = False
    balance_method: str = "oversample"
    balance_ratio: float = 0.05
    metric: str = ""
    metric_dataset: str = "valid"
    tune: str = ""                                      # "", grid, random or halving
    trials: int = 8
    cross_validation: str = "never"                     # never, always or auto (no later dataset, or few rows)
    folds: int = 5
    selection: str = "forest"                           # forest, chunked or statistical
    attribution: bool = False
    attribution_rows: int | None = None                 # None: all rows of the valid part
    profile: bool = False
    parallelism: int = 2


@dataclass(frozen=True)
class FitResult:
    """Fitted pipeline of the champion and the tables of the run."""
    model: PipelineModel
    task: str
    best: str
    metrics: DataFrame
    ranking: DataFrame
    preprocessor: Preprocessor
    trail: DataFrame
    profile: dict[str, DataFrame] = field(default_factory=dict)
    target: str | None = None
    key: str | None = None
    cross_validation: DataFrame | None = None           # model, mean and std of the fold metric
    attribution: DataFrame | None = None
    trials: DataFrame | None = None                     # settings tried by a density search

    def save(self, path: str) -> None:
        save_model(self.metrics.sparkSession, self.model, path, {
            "task": self.task, "best": self.best, "required": self.preprocessor.raw_columns, "target": self.target, "key": self.key,
            "features": self.preprocessor.feature_columns})


def _selected_raw(rows: DataFrame, target: str, key: str, task: str, cfg: FitConfig) -> tuple[list[str], Preprocessor]:
    """Column decisions and feature ranking on all rows of the train part."""
    pre = fit_preprocessor(rows, target, missing_threshold=cfg.missing_threshold, max_categories=cfg.max_categories,
                           exclude=[key, *cfg.exclude], scale=False, classify=task == "classification")
    ready = encoded_frame(pre, rows)
    ready = with_label(pre, ready) if task == "classification" else ready.withColumn("label", F.col(target).cast("double"))
    chosen = set(select_features(ready, pre.feature_columns, "label", task, cfg.max_features, cfg.selection))
    return [c for c in pre.raw_columns if c in chosen or c + "_encoded" in chosen], pre


def _supervised(df: DataFrame, target: str, key: str, task: str, cfg: FitConfig, later: dict[str, DataFrame]) -> FitResult:
    sizes = {"train": cfg.train_size, "valid": cfg.valid_size, "test": 1.0 - cfg.train_size - cfg.valid_size}
    raw, ranked = _selected_raw(train_valid_test(df, key, cfg.train_size, cfg.valid_size, cfg.seed)["train"], target, key, task, cfg)
    # the part of a row is found once; the raw columns take less room than their vectors, the key only stays where a step needs it
    keyed = task == "classification" or cfg.tune or cfg.attribution or cfg.cross_validation != "never"
    keys = [key] if keyed else []
    split = with_split(df.select(key, target, *raw), key, sizes, cfg.seed).select("dataset", *keys, target, *raw).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _trained(split, raw, ranked, df, target, key, keys, task, cfg, later)
    finally:
        split.unpersist()


def _trained(split: DataFrame, raw: list[str], ranked: Preprocessor, df: DataFrame, target: str, key: str, keys: list[str], task: str, cfg: FitConfig,
             later: dict[str, DataFrame]) -> FitResult:
    parts = {n: split.where(F.col("dataset") == n).drop("dataset") for n in ("train", "valid", "test")}
    pre = fit_preprocessor(parts["train"], target, keep=raw, missing_threshold=1.0,
                           max_categories=cfg.max_categories, classify=task == "classification")
    classes, synthetic = 2, False
    train_rows = parts["train"]
    if task == "classification":
        dist = class_distribution(train_rows, target)
        classes = dist.count()
        if classes < 2:
            raise ValueError("the target has a single class")
        if cfg.auto_balance and detect_imbalance(dist, cfg.balance_ratio).first()["is_imbalanced"]:
            if cfg.balance_method == "oversample":
                train_rows = oversample(train_rows, target, key, cfg.balance_ratio, cfg.seed).drop("copy")
            elif cfg.balance_method != "smote":
                raise ValueError(f"unknown balance method: {cfg.balance_method}")
            synthetic = cfg.balance_method == "smote"

    def ready(d: DataFrame, *more: str) -> DataFrame:
        out = pre.transform(d)
        out = with_label(pre, out) if task == "classification" else out.withColumn("label", F.col(target).cast("double"))
        return out.select(*more, *keys, "features", "label")

    train = _synthetic(ready(train_rows), key, len(pre.feature_columns), cfg) if synthetic else ready(train_rows)
    # rows that only balancing makes, and those of later tables, are not among the stored ones
    stored = [train.persist(StorageLevel.MEMORY_AND_DISK)] if train_rows is not parts["train"] or synthetic else []
    try:
        data = {n: ready(d) for n, d in parts.items()}
        tagged = ready(split, "dataset")
        if later:
            stored.append(tag_datasets({n: ready(d) for n, d in later.items()}).persist(StorageLevel.MEMORY_AND_DISK))
            tagged = tagged.unionByName(stored[-1])
        width = len(pre.feature_columns)
        names = list(cfg.models) or (["logistic", "random_forest", "decision_tree"] if task == "classification"
                                     else ["linear_regression", "random_forest", "decision_tree"])
        metric = cfg.metric or (("ks" if classes == 2 else "accuracy") if task == "classification" else "rmse")
        fitted, rows = {}, None
        for name in names:
            if task == "classification" and name in M.BINARY_ONLY and classes > 2:
                continue
            params = dict(cfg.params.get(name, {}))
            variants = {name: tune.builder(task, name, width, classes)(**params).fit(train)}
            if cfg.tune:
                variants[name + "_tuned"] = _tuned(train, data["valid"], key, task, name, width, classes, cfg)
            part = None
            for variant, model in variants.items():
                m = evaluate(model.transform(tagged), key, task, classes).withColumn("model", F.lit(variant))
                part = m if part is None else part.unionByName(m)
            if cfg.tune:
                pair = part.withColumn("model", F.when(F.col("model") == name, "default").otherwise("tuned"))
                keep = S.tuned_or_default(pair, metric, dataset=cfg.metric_dataset).first()["decision"]
                chosen = name if keep == "default" else name + "_tuned"
                part = part.where(F.col("model") == chosen).withColumn("model", F.lit(name))
                fitted[name] = variants[chosen]
            else:
                fitted[name] = variants[name]
            rows = part if rows is None else rows.unionByName(part)
        # one row per model, dataset and metric
        rows, _ = pin_small(rows)
        folds = None
        count = parts["train"].count() if cfg.cross_validation == "auto" else 0
        if tune.use_cross_validation(cfg.cross_validation, count, bool(later)):
            # the rows before balancing
            whole = cross_validation_frame([data[n] for n in ("train", "valid", "test")], key, cfg.folds, cfg.seed)
            scores = []
            for name in fitted:
                _, mean, std = tune.cross_validate(whole, task, name, cfg.folds, features=width, classes=classes, parallelism=cfg.parallelism, **cfg.params.get(name, {}))
                scores.append((name, mean, std))
            folds = local_frame(df.sparkSession, scores, "model string, mean double, std double")
        choose = S.champion_classification if task == "classification" else S.champion_regression
        ranking = choose(rows, metric, cfg.metric_dataset)
        best = ranking.where(F.col("rank") == 1).first()["model"]
        shares = None
        if cfg.attribution:
            # exact for trees, sampled orders for other models
            explain = tree_attribution if best in TREES else shapley
            shares, _ = pin_small(mean_attribution(explain(data["valid"], fitted[best], key, pre.feature_columns, max_rows=cfg.attribution_rows, seed=cfg.seed)))
    finally:
        for frame in stored:
            frame.unpersist()
    stages = [*pre.model.stages, fitted[best]]
    if pre.labels:
        stages.append(IndexToString(inputCol="prediction", outputCol="predicted_" + target, labels=list(pre.labels)))
    profile = {}
    if cfg.profile:
        profile = full_profile(tag_datasets({"train": parts["train"].select(target, *raw), **{n: d.select(target, *raw) for n, d in later.items()}}),
                               raw, target, "classification" if task == "classification" else "regression", by=["dataset"])
    types = {f.name: f.dataType.simpleString() for f in df.schema if f.name not in (target, key)}
    lost = [(c, "selection", "not among the most important features") for c in ranked.raw_columns if c not in raw]
    dropped = {c: (c, step, why) for c, step, why in [*pre.dropped, *lost, *ranked.dropped] if step != "names" or c not in ranked.raw_columns}
    kept = [c for c in raw if c in pre.raw_columns]
    trail = audit_trail(df.sparkSession, types, list(dropped.values()), kept)
    return FitResult(PipelineModel(stages), task, best, rows, ranking, pre, trail, profile, target, key, folds, shares)


def _synthetic(ready_rows: DataFrame, key: str, width: int, cfg: FitConfig) -> DataFrame:
    """Rows between neighbours of the small classes, on the encoded and scaled features."""
    arr = vector_to_array("features")
    names = [f"f{i}" for i in range(width)]
    flat = ready_rows.select(key, "label", *[arr.getItem(i).alias(n) for i, n in enumerate(names)])
    out = smote(flat, "label", key, names, cfg.balance_ratio, seed=cfg.seed)
    return out.select(array_to_vector(F.array(*names)).alias("features"), "label")


def _tuned(train, valid, key, task, name, width, classes, cfg: FitConfig):
    if cfg.tune == "grid":
        return tune.grid_search(train, valid, task, name, features=width, classes=classes, parallelism=cfg.parallelism)[1]
    if cfg.tune == "random":
        return tune.random_search(train, valid, task, name, cfg.trials, features=width, classes=classes, parallelism=cfg.parallelism)[1]
    if cfg.tune == "halving":
        return tune.halving_search(train, valid, key, task, name, cfg.trials, features=width, classes=classes, parallelism=cfg.parallelism)[1]
    raise ValueError(f"unknown search: {cfg.tune}")


def evaluate(predictions: DataFrame, key: str, task: str, classes: int = 2) -> DataFrame:
    """Metric rows of every dataset at once."""
    if task == "regression":
        return RM.validate_regression(predictions, "label")
    if classes > 2:
        return BM.validate_multiclass(predictions)
    return BM.validate_binary(M.with_score(predictions), key)


def fit_classifier(df: DataFrame, target: str, key: str, config: FitConfig | None = None, later: dict[str, DataFrame] | None = None) -> FitResult:
    """L1: split, select on the train part, preprocess and train on the full train part, compare on all parts, choose."""
    return _supervised(df.where(F.col(target).isNotNull()), target, key, "classification", config or FitConfig(), later or {})


def fit_regressor(df: DataFrame, target: str, key: str, config: FitConfig | None = None, later: dict[str, DataFrame] | None = None) -> FitResult:
    """L2."""
    later = {n: clean_numeric_target(d, target) for n, d in (later or {}).items()}
    return _supervised(clean_numeric_target(df, target), target, key, "regression", config or FitConfig(), later)


NOT_FOR_CLUSTERS = {"auto_balance", "balance_method", "balance_ratio", "metric", "metric_dataset", "tune", "trials", "max_features", "selection", "attribution", "attribution_rows"}


def fit_clusterer(df: DataFrame, key: str, config: FitConfig | None = None, k_range: Sequence[int] = (2, 3, 4, 5),
                  method: str = "silhouette", later: dict[str, DataFrame] | None = None) -> FitResult:
    """L3: unsupervised preprocessing, every algorithm over the k range, quality per dataset, choice.

    ``dbscan`` searches its grid on the train part (``params["dbscan"]``: ``eps_values``, ``min_pts_values``, or a fixed
    ``eps`` and ``min_pts``); the rows of all parts take the label of the nearest core row in reach. Noise counts as no
    cluster: quality leaves it out, ``noise_count`` gives its rows.
    """
    from featurelens.operators.cluster_metrics import evaluate_clusters
    cfg = config or FitConfig()
    unused = [f.name for f in fields(cfg) if f.name in NOT_FOR_CLUSTERS and getattr(cfg, f.name) != f.default]
    if unused:
        raise ValueError(f"options that a clustering has no use for: {unused}")
    cats, nums = clustering_columns(df.drop(key, *cfg.exclude))
    parts = clustering_split(df, key, cfg.train_size, cfg.valid_size, 1 - cfg.train_size - cfg.valid_size, cfg.seed)
    train_raw = parts.where(F.col("dataset") == "train")
    facts = column_facts(train_raw, [*cats, *nums])
    why = [(c, "missing", "too many missing values") for c in (*cats, *nums) if (facts[c]["missing"] or 0.0) > cfg.missing_threshold]
    why += [(c, "cardinality", "too many categories") for c in cats if facts[c]["distinct"] > cfg.max_categories]
    gone = {c for c, _, _ in why}
    cats, nums = [c for c in cats if c not in gone], [c for c in nums if c not in gone]
    pre = Preprocessor(build_preprocessing(train_raw, cats, nums).fit(train_raw), tuple(cats), tuple(nums))
    train = pre.transform(train_raw).select(key, "features").persist(StorageLevel.MEMORY_AND_DISK)
    everything = parts
    for name, d in (later or {}).items():
        everything = everything.unionByName(d.withColumn("dataset", F.lit(name)))
    tagged = pre.transform(everything).select(key, "dataset", "features")
    try:
        fitted, rows, folds, trials = {}, None, None, None
        check = tune.use_cross_validation(cfg.cross_validation, train.count(), bool(later))
        for name in list(cfg.models) or ["kmeans", "bisecting_kmeans"]:
            params = cfg.params.get(name, {})
            if name == "dbscan":
                fitted[name], trials = fit_density_model(train, key, **params)
                again = _same_density(fitted[name], key)
            else:
                models, table = M.fit_k_range(train, name, k_range, **params)
                k = int(S.choose_k(table).first()["best_k"])
                fitted[name], again = models[k], M.clusterer(name, k, **params).fit
            if check:
                held = tune.fold_summary(tune.cluster_folds(with_folds(train, key, cfg.folds, cfg.seed), name, folds=cfg.folds, fit=again))
                held = held.select(F.lit(name).alias("model"), "metric", "mean", "std", "min", "max", "folds")
                folds = held if folds is None else folds.unionByName(held)
            placed = fitted[name].transform(tagged).select("dataset", "features", "prediction").persist(StorageLevel.MEMORY_AND_DISK)
            try:
                wide = evaluate_clusters(placed.where(F.col("prediction") != NOISE), by=["dataset"])
                part = BM.to_metric_rows(wide, ["dataset"], ["silhouette", "calinski_harabasz", "davies_bouldin", "inertia", "num_clusters", "sample_count"])
                if name == "dbscan":
                    noise = placed.groupBy("dataset").agg(F.count_if(F.col("prediction") == NOISE).alias("noise_count"))
                    part = part.unionByName(BM.to_metric_rows(noise, ["dataset"], ["noise_count"]))
                part, _ = pin_small(part.withColumn("model", F.lit(name)))
            finally:
                placed.unpersist()
            rows = part if rows is None else rows.unionByName(part)
        rows, _ = pin_small(rows)
        folds = None if folds is None else pin_small(folds)[0]
    finally:
        train.unpersist()
    source = F.when(F.col("dataset") == "valid", "validation").otherwise(F.col("dataset"))
    scores = rows.where(F.col("metric") == method).select("model", source.alias("source"), "value")
    best = S.best_clustering(scores, method).first()["best_model"]
    ranking = S.ranking(rows, method, "valid", higher=method != "davies_bouldin")
    model = PipelineModel([*pre.model.stages, fitted[best]])
    profile = profile_clusters(model.transform(train_raw), nums, cats) if cfg.profile else {}
    types = {f.name: f.dataType.simpleString() for f in df.schema if f.name != key}
    used = set(cats) | set(nums)
    trail = audit_trail(df.sparkSession, types, [*why, *[(c, "kinds", "not a feature") for c in types if c not in used and c not in gone]], [*cats, *nums])
    return FitResult(model, "clustering", best, rows, ranking, pre, trail, profile, None, key, folds, trials=trials)


def _same_density(model, key: str):
    """Fit of other rows with the setting of ``model``."""
    eps, min_pts = model.getOrDefault(model.eps), model.getOrDefault(model.minPts)
    return lambda df: model if eps < 0 else fit_density_model(df, key, eps, min_pts)[0]


def cross_validation_frame(parts: Sequence[DataFrame], key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Train, valid and test rows (not the over-sampled ones) in one frame with a fold column."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return with_folds(out, key, folds, seed)
