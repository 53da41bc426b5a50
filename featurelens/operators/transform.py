"""Fit on train, apply anywhere. The fitted object is one ``PipelineModel``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    Imputer, IndexToString, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from featurelens.functions.expressions import NULL_TOKENS, NOT_NUMERIC_CHARS, as_double, field_type, is_string
from featurelens.operators import columns as C

IMPUTE_VALUE = -999.0
MAX_CLASSES = 1000


def index_categoricals(df: DataFrame, columns: Sequence[str], suffix: str = "_encoded") -> StringIndexerModel:
    """fit label indexes, most frequent first, ties by value; unseen and null share an extra index."""
    return StringIndexer(inputCols=list(columns), outputCols=[c + suffix for c in columns],
                         handleInvalid="keep", stringOrderType="frequencyDesc").fit(df)


def index_target(df: DataFrame, target: str, output: str = "label") -> tuple[StringIndexerModel, IndexToString]:
    """target index and its inverse."""
    model = StringIndexer(inputCol=target, outputCol=output, handleInvalid="error").fit(df)
    return model, IndexToString(inputCol="prediction", outputCol="predicted_" + target, labels=model.labels)


def frequency_index(df: DataFrame, column: str, output: str) -> DataFrame:
    """Replace a text column by its frequency index (used for correlations)."""
    model = StringIndexer(inputCol=column, outputCol="_index", handleInvalid="keep").fit(df)
    out = model.transform(df)
    return out.drop(column).withColumnRenamed("_index", output) if column == output else out.withColumnRenamed("_index", output)


def impute_constant(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """null and NaN to a constant."""
    return df.withColumns({c: F.coalesce(as_double(c, field_type(df, c)), F.lit(float(value))) for c in columns})


def impute_fitted(df: DataFrame, columns: Sequence[str], strategy: str = "mean"):
    """F3 option: fitted mean or median imputation."""
    return Imputer(inputCols=list(columns), outputCols=list(columns), strategy=strategy).fit(df)


def assemble(df: DataFrame, columns: Sequence[str], output: str = "features", on_invalid: str = "keep") -> DataFrame:
    """one vector column."""
    return VectorAssembler(inputCols=list(columns), outputCol=output, handleInvalid=on_invalid).transform(df)


def fit_scaler(train: DataFrame, columns: Sequence[str], on_invalid: str = "keep") -> PipelineModel:
    """assemble and scale to unit standard deviation without centring, fitted on train only."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(columns), outputCol="raw_features", handleInvalid=on_invalid),
        StandardScaler(inputCol="raw_features", outputCol="features", withStd=True, withMean=False),
    ]).fit(train)


def scaled_columns(df: DataFrame, columns: Sequence[str], vector: str = "features", suffix: str = "_scaled") -> DataFrame:
    """Vector entries as named columns (F5 as columns)."""
    arr = vector_to_array(vector)
    return df.withColumns({c + suffix: arr.getItem(i) for i, c in enumerate(columns)})


@dataclass(frozen=True)
class Preprocessor:
    """F10/F11 result: the fitted pipeline and the column names it needs."""
    model: PipelineModel
    categorical: tuple[str, ...]
    numeric: tuple[str, ...]
    target: str | None = None
    labels: tuple[str, ...] = ()
    dropped: tuple[tuple[str, str, str], ...] = field(default_factory=tuple)   # (column, step, reason)

    @property
    def raw_columns(self) -> list[str]:
        return [*self.categorical, *self.numeric]

    @property
    def feature_columns(self) -> list[str]:
        return [c + "_encoded" for c in self.categorical] + list(self.numeric)

    def transform(self, df: DataFrame) -> DataFrame:
        """Raw columns in, encoded, imputed and scaled columns out."""
        check_columns(df, self.raw_columns)
        return self.model.transform(df)


def check_columns(df: DataFrame, needed: Sequence[str]) -> None:
    lost = [c for c in needed if c not in df.columns]
    if lost:
        raise ValueError(f"required columns are missing: {lost}")


def _clean_sql(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], impute: float) -> str:
    """Row-level cleaning as the SQL text of a savable ``SQLTransformer``."""
    tokens = ", ".join(f"'{t}'" for t in NULL_TOKENS)
    items = []
    for c in categorical:
        items.append(f"CASE WHEN trim(`{c}`) = '' THEN NULL ELSE CAST(`{c}` AS STRING) END AS `{c}__text`")
    for c in numeric:
        t = field_type(df, c)
        if is_string(t):
            num = (f"CASE WHEN trim(`{c}`) IN ({tokens}) THEN NULL "
                   f"ELSE try_cast(regexp_replace(`{c}`, '{NOT_NUMERIC_CHARS}', '') AS DOUBLE) END")
        elif isinstance(t, T.BooleanType):
            num = f"CAST(CAST(`{c}` AS INT) AS DOUBLE)"
        else:
            num = f"nanvl(CAST(`{c}` AS DOUBLE), NULL)"
        items.append(f"coalesce({num}, {impute}D) AS `{c}__num`")
    return "SELECT *, " + ", ".join(items) + " FROM __THIS__"


def build_preprocessing(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], target: str | None = None,
                        impute: float = IMPUTE_VALUE, scale: bool = True) -> Pipeline:
    """The stages clean, index, assemble and scale as one estimator."""
    if not categorical and not numeric:
        raise ValueError("no feature columns are left")
    stages = [SQLTransformer(statement=_clean_sql(df, categorical, numeric, impute))]
    if categorical:
        stages.append(StringIndexer(inputCols=[c + "__text" for c in categorical],
                                    outputCols=[c + "_encoded" for c in categorical], handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=[c + "_encoded" for c in categorical] + [c + "__num" for c in numeric],
                                  outputCol="raw_features", handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="raw_features", outputCol="features", withStd=True, withMean=False))
    else:
        stages.append(SQLTransformer(statement="SELECT *, raw_features AS features FROM __THIS__"))
    return Pipeline(stages=stages)


def fit_preprocessor(
    train: DataFrame, target: str | None, *, keep: Sequence[str] | None = None, missing_threshold: float = 0.75,
    max_categories: int = 50, impute: float = IMPUTE_VALUE, exact: bool = False, scale: bool = True, exclude: Sequence[str] = (),
    classify: bool = False,
) -> Preprocessor:
    """F10 (with a target) and F11 (without): decide the columns, then fit one pipeline on train.

    Order: name rules, dates, missing share, kinds, cardinality, index, impute, scale.
    """
    dropped: list[tuple[str, str, str]] = []

    def step(name: str, before: Sequence[str], after: Sequence[str], reason: str) -> list[str]:
        dropped.extend((c, name, reason) for c in before if c not in after)
        return list(after)

    every = [c for c in train.columns if c != target]
    cols = step("names", every, C.pick_columns(every, include=keep or (), exclude=exclude), "excluded by name")
    facts = C.column_facts(train, cols)
    dates = [c for c in cols if C.is_date(field_type(train, c)) or (facts[c]["date_share"] or 0.0) > 0.5]
    cols = step("dates", cols, [c for c in cols if c not in dates], "date column")
    cols = step("missing", cols, [c for c in cols if (facts[c]["missing"] or 0.0) <= missing_threshold], "too many missing values")
    cats, nums = C.split_by_kind(train, cols)
    few = C.low_cardinality_columns(train, cats, max_categories, True) if exact else [c for c in cats if facts[c]["distinct"] <= max_categories]
    cats = step("cardinality", cats, few, "too many categories")
    model = build_preprocessing(train, cats, nums, target, impute, scale).fit(train)
    labels: tuple[str, ...] = ()
    if target is not None and is_string(field_type(train, target)):
        indexer, _ = index_target(train, target)
        labels = tuple(indexer.labels)
    elif target is not None and classify:
        # one row per class; a target of 0 and 1 is its own label
        value = F.col(target).cast("double")
        classes = train.where(value.isNotNull()).select(F.col(target).cast("string").alias("name"), value.alias("value")).distinct().limit(MAX_CLASSES + 1).collect()
        if len(classes) > MAX_CLASSES:
            raise ValueError(f"the target has more than {MAX_CLASSES} classes")
        if not {r["value"] for r in classes} <= {0.0, 1.0}:
            labels = tuple(r["name"] for r in sorted(classes, key=lambda r: r["value"]))
    return Preprocessor(model, tuple(cats), tuple(nums), target, labels, tuple(dropped))


def encoded_frame(pre: Preprocessor, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """the encoded and imputed columns under their feature names, without the raw ones."""
    out = pre.transform(df)
    cols = [F.col(c + "_encoded") for c in pre.categorical] + [F.col(c + "__num").alias(c) for c in pre.numeric]
    extra = [F.col(pre.target)] if pre.target and pre.target in df.columns else []
    return out.select(*keys, *cols, *extra)


def prepare_later_data(pre: Preprocessor, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """out-of-time data; a missing target or column is an error, not a dropped dataset."""
    check_columns(df, [*pre.raw_columns, *([pre.target] if pre.target else [])])
    return encoded_frame(pre, df, keys)


def with_label(pre: Preprocessor, df: DataFrame, output: str = "label") -> DataFrame:
    """Target as the numeric ``label`` column; a target that is not 0 and 1 uses the indexes of train."""
    if pre.target is None:
        raise ValueError("no target was given")
    if pre.labels:
        model = StringIndexerModel.from_labels(list(pre.labels), inputCol=pre.target, outputCol=output, handleInvalid="error")
        return model.transform(df)
    return df.withColumn(output, F.col(pre.target).cast("double"))
