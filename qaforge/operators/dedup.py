"""Identity, duplicate classes and ingest of question/answer rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_id, sha256
from ..schema import CONTEXT_SIMILARITY
from ..sources.store import bounded_batches, staged
from .similarity import similar_texts
from .validate import confidence_or_one, required


def build_rows(items: DataFrame, clock) -> DataFrame:
    """Rows of the store from question, answer, context, confidence, source_url, index and any other columns.

    A missing question or answer is an error. clock is a column: the time of generation.
    """
    empty = F.lit("")
    q, a, c, u = (F.coalesce(F.col(x), empty) for x in ("question", "answer", "context", "source_url"))
    rest = [x for x in items.columns if x not in ("question", "answer", "context", "confidence", "source_url", "index", "id")]
    rows = required(items, "question", "answer").withColumn("id", content_id(q, c, u))
    return rows.select(
        "id",
        *rest,
        F.struct(q.alias("question"), c.alias("context"), u.alias("source_url"), F.col("index").cast("int").alias("index")).alias("input"),
        F.struct(a.alias("answer"), confidence_or_one(F.col("confidence")).alias("confidence")).alias("expected_output"),
        F.struct(clock.cast("string").alias("generation_timestamp"), F.length(c).alias("context_length"), F.length(q).alias("question_length"), F.length(a).alias("answer_length"), F.col("id").alias("content_hash")).alias("qa_metadata"),
    )


def exact_groups(rows: DataFrame) -> DataFrame:
    """Ids that more than one row has, with their number and first row (seq)."""
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).where("n > 1")


def classify(batch: DataFrame, store: DataFrame, threshold: float = 0.9, context_threshold: float = CONTEXT_SIMILARITY) -> DataFrame:
    """batch with type (exact, similar or new), duplicate_id and similarity_score, against the store as it is.

    Both: id, seq, question, context, source_url. Exact: the store has the id. Similar: a row of the same source_url whose
    question reaches the threshold and whose context reaches context_threshold; the first one by seq counts, with its
    question's ratio. Rows of one batch are not compared with each other.
    """
    ids = store.groupBy("id").agg(F.first("id").alias("_exact")).select("id", "_exact")
    probed = batch.join(ids, "id", "left")
    if threshold < 1 or context_threshold < 1:
        # Both sides are read several times from here on.
        probed, store = staged(probed, "probed"), staged(store.select("id", "seq", "question", "context", "source_url"), "compared")
    new = probed.where("_exact IS NULL")
    empty = F.lit("")
    bounded_batches(batch.sparkSession)
    # Rows that share source, question and context are one class: of the store's, the first by seq counts. Classes have their
    # contexts' digests in place of contexts, which are long.
    context = F.coalesce("context", empty)
    side = lambda df, name: df.select(F.coalesce("source_url", empty).alias("source_url"), F.coalesce("question", empty).alias(f"q{name}"), sha256(context).alias(f"h{name}"), F.col("id").alias(f"id_{name}"), F.col("seq").alias(f"seq_{name}"))
    a, b = side(new, "a"), side(store, "b")
    texts = lambda df, col, name: df.select("source_url", F.col(col).alias(name)).distinct()
    questions = similar_texts(texts(a, "qa", "a"), texts(b, "qb", "b"), ["source_url"], threshold).select("source_url", F.col("a").alias("qa"), F.col("b").alias("qb"), "ratio")
    first = b.groupBy("source_url", "qb", "hb").agg(F.min_by("id_b", "seq_b").alias("id_b"), F.min("seq_b").alias("seq_b"))
    classes = a.select("source_url", "qa", "ha").distinct()
    if context_threshold >= 1:
        passed = classes.join(questions, ["source_url", "qa"]).join(first.withColumn("ha", F.col("hb")), ["source_url", "qb", "ha"])
    else:
        # A question of the batch is in one group, named after the least question it is similar to, and one of the store's in those
        # of the questions similar to it: few, as these are like each other. So contexts meet in cells of a group, in a number
        # that follows rows; pairs are made of those that are similar.
        questions = staged(questions, "similar-questions")
        group = sha256(F.to_json(F.struct("source_url", "m"))).alias("group")
        of_a = questions.groupBy("source_url", "qa").agg(F.min("qb").alias("m")).select("source_url", "qa", group)
        of_b = questions.join(of_a, ["source_url", "qa"]).select("source_url", "qb", "group").distinct()
        whole = lambda df, of, name: df.select(F.coalesce("source_url", empty).alias("source_url"), F.coalesce("question", empty).alias(f"q{name}"), context.alias(name)).join(of, ["source_url", f"q{name}"]).select("group", name).distinct()
        alike = similar_texts(whole(new, of_a, "a"), whole(store, of_b, "b"), ["group"], context_threshold).select("group", sha256(F.col("a")).alias("ha"), sha256(F.col("b")).alias("hb"))
        pairs = staged(classes.join(of_a, ["source_url", "qa"]).join(alike, ["group", "ha"]).drop("group"), "pairs-of-classes")
        passed = pairs.join(first, ["source_url", "hb"]).join(questions, ["source_url", "qa", "qb"])
    of_class = passed.groupBy("source_url", "qa", "ha").agg(F.min_by(F.struct("id_b", "ratio", "seq_b"), "seq_b").alias("_hit"))
    best = a.join(of_class, ["source_url", "qa", "ha"]).groupBy("id_a", "seq_a").agg(F.min_by("_hit", "_hit.seq_b").alias("_hit"))
    out = probed.join(best.select(F.col("id_a").alias("id"), F.col("seq_a").alias("seq"), "_hit"), ["id", "seq"], "left")
    return out.select(
        *batch.columns,
        F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_hit").isNotNull(), "similar").otherwise("new").alias("type"),
        F.coalesce("_exact", F.col("_hit.id_b")).alias("duplicate_id"),
        F.when(F.col("_exact").isNotNull(), 1.0).otherwise(F.coalesce(F.col("_hit.ratio"), F.lit(0.0))).alias("similarity_score"),
    )


def ingest(batch: DataFrame, store: DataFrame, threshold: float = 0.9, context_threshold: float = CONTEXT_SIMILARITY) -> DataFrame:
    """classify, and of new rows that share an id within the batch only the first by seq is new; the others are exact."""
    found = classify(batch, store, threshold, context_threshold)
    again = F.row_number().over(Window.partitionBy("id", "type").orderBy("seq")) > 1
    is_again = (F.col("type") == "new") & F.col("_again")
    out = found.withColumn("_again", again)
    return out.withColumns({"duplicate_id": F.when(is_again, F.col("id")).otherwise(F.col("duplicate_id")), "similarity_score": F.when(is_again, 1.0).otherwise(F.col("similarity_score")), "type": F.when(is_again, "exact").otherwise(F.col("type"))}).drop("_again")


def counters(found: DataFrame, *by: str) -> DataFrame:
    """total (new rows), exact_duplicates and similar_duplicates."""
    n = lambda kind: F.count_if(F.col("type") == kind)
    return found.groupBy(*by).agg(n("new").alias("total"), n("exact").alias("exact_duplicates"), n("similar").alias("similar_duplicates"))
