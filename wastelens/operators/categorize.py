"""Rule and model categories (M2-M4).

Rules are an ordered list of (category, keywords); the first category with
a keyword contained in ``lower(vendor || ' ' || description)`` wins. The
model slot takes any fitted ``pyspark.ml`` model that outputs a string
prediction column.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wastelens import schemas


def category_text(vendor: str = "vendor", description: str = "description") -> Column:
    return F.lower(F.concat(F.coalesce(F.col(vendor).cast("string"), F.lit("")), F.lit(" "),
                            F.coalesce(F.col(description).cast("string"), F.lit(""))))


#: From this many keywords on they are looked for at once, not one after the other.
MANY = 64


def rule_category(text: Column, rules=None, match: str = "substring") -> Column:
    """First matching category or null. ``match='word'`` requires whole words
    (so "ups" no longer hits "cups").

    Few keywords are tested one by one in the JVM. A long list becomes one automaton (Aho, Corasick
    1975) that reads each text once, however many keywords there are.
    """
    rules = schemas.DEFAULT_RULES if rules is None else rules
    if sum(len(keys) for _, keys in rules) >= MANY:
        return _by_automaton(text, rules, match)
    whens = []
    for cat, keys in rules:
        if match == "word":
            pat = r"\b(" + "|".join(re.escape(k) for k in keys) + r")\b"
            hit = text.rlike(pat)
        else:
            hit = F.lit(False)
            for k in keys:
                hit = hit | text.contains(F.lit(k))
        whens.append(F.when(hit, F.lit(cat)))
    return F.coalesce(*whens) if whens else F.lit(None).cast("string")


class KeywordAutomaton:
    """The first rule of an ordered list with a keyword in a text; -1 if none."""

    def __init__(self, keywords: list[list[str]], match: str):
        import ahocorasick

        self.whole, self.none, self.automaton = match == "word", len(keywords), ahocorasick.Automaton()
        self.always = self.none
        for rule in range(len(keywords) - 1, -1, -1):  # of rules that share a keyword the first
            for k in keywords[rule]:
                if k:
                    self.automaton.add_word(k, (rule, len(k)))
                elif not self.whole:
                    self.always = rule  # contained in any text
        if len(self.automaton):
            self.automaton.make_automaton()

    def first_rule(self, text: str) -> int:
        best = self.always
        if len(self.automaton):
            for last, (rule, size) in self.automaton.iter(text):
                if rule < best and not (self.whole and not (_edge(text, last + 1 - size) and _edge(text, last + 1))):
                    best = rule
                    if best == 0:
                        break
        return best if best < self.none else -1


def _edge(text: str, at: int) -> bool:
    """Whether a word (letters, digits, underscore) begins or ends at a place."""
    def inside(k: int) -> bool:
        return 0 <= k < len(text) and (text[k] == "_" or unicodedata.category(text[k])[0] == "L" or unicodedata.category(text[k]) == "Nd")
    return inside(at - 1) != inside(at)


def _by_automaton(text: Column, rules, match: str) -> Column:
    keywords = [list(keys) for _, keys in rules]

    @F.pandas_udf("int")
    def rule(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = KeywordAutomaton(keywords, match)  # once for a task
        for t in texts:
            yield t.map(automaton.first_rule, na_action="ignore").fillna(-1).astype("int32")
    # get() gives null for -1.
    return F.get(F.array(*[F.lit(cat) for cat, _ in rules]), rule(text))


def categorize_rules(df: DataFrame, rules=None, match: str = "substring",
                     vendor: str = "vendor", description: str = "description") -> DataFrame:
    """M2: ``rule_cat``, ``ai_category`` (= rule) and ``ai_category_source``."""
    rc = rule_category(category_text(vendor, description), rules, match)
    return (df.withColumn("rule_cat", rc)
            .withColumn("ai_category", F.col("rule_cat"))
            .withColumn("ai_category_source",
                        F.when(F.col("rule_cat").isNotNull(), "rule").otherwise("unknown")))


def train_category_model(labelled: DataFrame, label_col: str = "category",
                         vendor: str = "vendor", description: str = "description",
                         num_features: int = 1 << 18, max_iter: int = 50) -> PipelineModel:
    """M4: TF-IDF + logistic regression on ``vendor description`` text.

    Training is distributed (treeAggregate of gradients); the fitted model
    holds num_features x classes coefficients, independent of data size.
    """
    d = labelled.withColumn("_text", category_text(vendor, description)) \
                .where(F.col(label_col).isNotNull())
    indexer = StringIndexer(inputCol=label_col, outputCol="_label", handleInvalid="skip")
    stages = [
        RegexTokenizer(inputCol="_text", outputCol="_tokens", pattern=r"\W+", minTokenLength=1),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
        IDF(inputCol="_tf", outputCol="_features"),
        indexer,
        LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=max_iter,
                           predictionCol="_pred", probabilityCol="_prob",
                           rawPredictionCol="_raw"),
    ]
    fitted = Pipeline(stages=stages).fit(d)
    labels = fitted.stages[3].labels
    back = IndexToString(inputCol="_pred", outputCol="ml_category", labels=labels)
    # Scoring needs no label: drop the label indexer from the fitted stages.
    return PipelineModel(stages=fitted.stages[:3] + [fitted.stages[4], back])


def categorize_model(df: DataFrame, model: PipelineModel, rules=None, match: str = "substring",
                     vendor: str = "vendor", description: str = "description") -> DataFrame:
    """M3: the model predicts every row; the rule result only fills a null
    prediction. Source is ``rule+ml`` when a rule matched, else ``ml``."""
    d = categorize_rules(df, rules, match, vendor, description).drop("ai_category", "ai_category_source")
    scored = model.transform(d.withColumn("_text", category_text(vendor, description)))
    out = (scored.withColumn("ai_category", F.coalesce(F.col("ml_category"), F.col("rule_cat")))
           .withColumn("ai_category_source",
                       F.when(F.col("rule_cat").isNotNull(), "rule+ml").otherwise("ml")))
    return out.drop(*[c for c in out.columns if c.startswith("_")], "ml_category")
