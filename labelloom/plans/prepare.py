"""The load-and-clean half of a training run, and the feature tables."""

from __future__ import annotations

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.sql import DataFrame

from labelloom.functions.hashing import array_key, key_digest
from labelloom.operators.curate import conflict_filter
from labelloom.operators.feature_sets import feature_set
from labelloom.operators.relational import drop_nulls, nonempty_tokens
from labelloom.operators.sampling import balance_classes, train_test_split
from labelloom.operators.tokens import comment_tokens
from labelloom.session import materialize


def token_corpus(comments: DataFrame, balance: bool = False, lemmas: DataFrame | None = None) -> DataFrame:
    """(id, comment, label, tokens): non-null, non-empty, unique token lists
    with one label each; optionally with classes of equal size, and with the
    lemmas of a table (form, lemma).

    Tokens and their digest are written once.  The grouping then scans only the
    id, label and digest columns of that table.
    """
    rows = (comment_tokens(drop_nulls(comments), lemmas)
            .withColumn("token_key", key_digest(array_key("tokens"))))
    rows = nonempty_tokens(materialize(rows, "tokens"))
    kept = conflict_filter(rows, "token_key").drop("token_key")
    return balance_classes(kept) if balance else kept


def sentence_corpus(comments: DataFrame, balance: bool = False) -> DataFrame:
    """(id, comment, label): the same with the raw comment as the key."""
    kept = conflict_filter(drop_nulls(comments), "comment")
    return balance_classes(kept) if balance else kept


def fit_once(pipeline: Pipeline, df: DataFrame, keep: tuple[str, ...] = ("id",)) -> PipelineModel:
    """Fit a pipeline whose leading stages need no fitting, evaluating those once.

    ``Pipeline.fit`` is lazy: every estimator would clean and tokenize all texts
    again.  Here the output of the leading transformers is written first.
    """
    stages = pipeline.getStages()
    first = next((i for i, s in enumerate(stages) if isinstance(s, Estimator)), len(stages))
    lead, rest = stages[:first], stages[first:]
    if not lead or not rest:
        return pipeline.fit(df)
    ready = PipelineModel(lead).transform(df).select(*keep, lead[-1].getOutputCol())
    fitted = Pipeline(stages=rest).fit(materialize(ready, "stage-input"))
    return PipelineModel([*lead, *fitted.stages])


def feature_tables(corpus: DataFrame, name: str, fit_on: str = "train", train_percent: int = 80,
                   seed: int = 42, **options) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Split, fit the feature pipeline on the train part, write both parts.

    ``fit_on="all"`` lets test rows shape the features; it is there to repeat
    such experiments, not to be recommended.
    """
    if fit_on not in ("train", "all"):
        raise ValueError("fit_on must be 'train' or 'all'")
    corpus = materialize(corpus, "corpus")
    train, test = train_test_split(corpus, train_percent, seed=seed)
    model = fit_once(feature_set(name, **options), train if fit_on == "train" else corpus)
    wanted = ("id", "label", "features")
    return (model, materialize(model.transform(train).select(*wanted), f"{name}-train"),
            materialize(model.transform(test).select(*wanted), f"{name}-test"))
