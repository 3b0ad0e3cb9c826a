"""Scored joins of labels with concepts, vault keys, options and intents. Rule tables are small, checked, and broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formweave.functions.text import key_of_label, token_score, words_of_label

#: A rule table of more rows is not broadcast by the operators here.
MOST_RULES = 10_000
LEAST_SCORE = 1.5


def rules(df: DataFrame) -> DataFrame:
    """A rule table, as a broadcast if it is small enough by count. Otherwise no side of its joins is: what it meets may be
    exploded, which Spark takes for no larger than its source."""
    return F.broadcast(df) if df.limit(MOST_RULES + 1).count() <= MOST_RULES else df.hint("merge")


def best_concept(labels: DataFrame, phrases: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(id, concept, score): the concept of the highest phrase score, the first by `ord` of equals, from `least` on.

    Labels and phrases meet on shared words only, so no label is paired with a phrase that scores nothing.
    """
    words = labels.select("id", F.split(words_of_label(F.col("label")), " ").alias("words"))
    by_word = rules(phrases.select("ord", "concept", "phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("w")))
    met = words.select("id", "words", F.explode(F.array_distinct("words")).alias("w")).where("w <> ''").join(by_word, "w")
    scored = met.select("id", "ord", "concept", token_score(F.col("words"), F.col("phrase")).alias("score"))
    best = scored.groupBy("id").agg(F.max_by(F.struct("concept", "score"), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select("id", "b.concept", F.col("b.score").alias("score")).where(F.col("score") >= least)


def own_values(labels: DataFrame, vault: DataFrame) -> DataFrame:
    """(id, value): the vault's value of the label's own key in any script; the first of equal keys; blanks are none."""
    held = vault.where("trim(value) <> ''").groupBy(key_of_label(F.col("key")).alias("k")).agg(F.min_by("value", "ord").alias("value"))
    return labels.select("id", key_of_label(F.col("label")).alias("k")).where("k <> ''").join(rules(held), "k").select("id", "value")


def resolve(labels: DataFrame, phrases: DataFrame, vault: DataFrame, blocked: Column) -> DataFrame:
    """(id, value, source): own key first, then concept, except where `blocked` (a predicate of the label) forbids it."""
    own = own_values(labels, vault).withColumnRenamed("value", "own")
    concept = best_concept(labels.where(~blocked), phrases).select("id", "concept")
    held = vault.where("trim(value) <> ''").select(F.col("key").alias("concept"), F.col("value").alias("found"))
    by_concept = concept.join(rules(held), "concept").select("id", "found")
    out = labels.select("id").join(own, "id", "left").join(by_concept, "id", "left")
    return out.select("id", F.coalesce("own", "found").alias("value"), F.when(F.col("own").isNotNull(), "own").when(F.col("found").isNotNull(), "concept").alias("source"))


def qualified_values(asked: DataFrame, vault: DataFrame, noun: str) -> DataFrame:
    """(id, value): the first vault key with both the asked qualifier and the noun among its words."""
    keys = vault.select("ord", "value", F.split(words_of_label(F.col("key")), " ").alias("k")).where(F.array_contains("k", noun))
    met = asked.join(rules(keys), F.expr("array_contains(k, qualifier)"))
    return met.groupBy("id").agg(F.min_by("value", "ord").alias("value"))


def prompt_values(asked: DataFrame, vault: DataFrame) -> DataFrame:
    """(id, value): the vault key whose words over two letters all stand in the prompt; the most words win."""
    words = asked.select("id", F.split(words_of_label(F.col("label")), " ").alias("p"))
    keys = vault.select("ord", "value", F.filter(F.split(words_of_label(F.col("key")), " "), lambda w: F.length(w) > 2).alias("k"))
    keys = rules(keys.where((F.size("k") >= 2) | F.exists("k", lambda w: F.length(w) >= 6)))
    met = words.join(keys, F.expr("size(array_except(k, p)) = 0"))
    return met.groupBy("id").agg(F.max_by("value", F.struct(F.size("k"), -F.col("ord"))).alias("value"))


def answers(asked: DataFrame, vault: DataFrame, stop: list[str]) -> DataFrame:
    """(id, value): the key with the most words in the question, of whose words no more than 34 % are missing."""
    drop = F.array(*map(F.lit, stop))
    words = lambda c: F.array_except(F.array_distinct(F.split(words_of_label(c), " ")), drop)
    q = asked.select("id", words(F.col("label")).alias("q"))
    k = rules(vault.select("ord", "value", words(F.col("key")).alias("k")).where("size(k) > 0"))
    met = q.join(k, F.expr("arrays_overlap(q, k)")).withColumn("hits", F.size(F.array_intersect("q", "k")))
    met = met.where((F.size("k") - F.col("hits")) <= F.floor(F.size("k") * 0.34))
    return met.groupBy("id").agg(F.max_by("value", F.struct("hits", -F.col("ord"))).alias("value"))


def unique_best(options: DataFrame) -> DataFrame:
    """(q, pos): the option with the most of the value's words, if no other has as many, and it has two, or all of a
    value of one or two words."""
    words = lambda c: F.array_distinct(F.filter(F.split(words_of_label(F.col(c)), " "), lambda w: w != ""))
    s = options.select("q", "pos", F.size(F.array_intersect(words("option"), words("value"))).alias("hits"), F.size(words("value")).alias("n"))
    w = Window.partitionBy("q")
    s = s.withColumns({"top": F.max("hits").over(w)}).withColumn("ties", F.count_if(F.col("hits") == F.col("top")).over(w))
    return s.where("hits = top AND ties = 1 AND (hits >= 2 OR (hits > 0 AND n <= 2 AND hits = n))").select("q", "pos")


def acronym(c: Column) -> Column:
    words = F.filter(F.split(F.regexp_replace(c, "[^A-Za-z ]", " "), " +"), lambda w: (w != "") & ~F.lower(w).isin("of", "the", "and"))
    return F.upper(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""))


def first_intent(asked: DataFrame, intents: DataFrame) -> DataFrame:
    """(id, intent): the first intent by `ord` whose pattern is found in the question."""
    met = asked.join(rules(intents), F.expr("rlike(lower(label), pattern)"))
    return met.groupBy("id").agg(F.min_by("intent", "ord").alias("intent"))
