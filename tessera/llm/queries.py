"""Queries of the training-text problems and the SQL of those that SQL can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import canonical, language, leakage, names, packing, splitting


def _names(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "entities")
    return reduce(
        DataFrame.unionByName,
        [
            names.named_values(entities, "entity_row", "title", "title"),
            names.named_values(entities, "entity_row", "aliases", "alias", many=True),
            names.named_values(table(spark, d, "id_aliases"), "alias_row", "alias_id", "id_alias"),
        ],
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.look_alike_pairs(names.with_form(_names(spark, d), "value"))


def p3_names(spark: SparkSession, d: str) -> DataFrame:
    return names.with_form(_names(spark, d), "value")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return names.look_groups(names.with_form(_names(spark, d), "value").where("form != ''"))


def p3_members(spark: SparkSession, d: str) -> DataFrame:
    return names.look_members(names.with_form(_names(spark, d), "value"))


def p3_sound(spark: SparkSession, d: str) -> DataFrame:
    """Forms that are not their own form, and pairs of rows that are in no common class: none of either."""
    once = names.with_form(_names(spark, d), "value")
    again = names.with_form(once.where("form is not null").select(F.col("form").alias("value")), "value", "form")
    pairs = names.look_alike_pairs(once)
    members = names.look_members(once)
    a = members.select("field", F.col("key").alias("key_a"), F.col("class").alias("class"))
    b = members.select("field", F.col("key").alias("key_b"), F.col("class").alias("class"))
    together = pairs.join(a, ["field", "key_a"]).join(b, ["field", "key_b", "class"], "left_semi").select("field", "key_a", "key_b").distinct()
    told = again.agg(F.count_if(F.col("form") != F.col("value")).alias("n_unstable"), F.lit(0).cast("bigint").alias("n_apart"))
    apart = pairs.join(together, ["field", "key_a", "key_b"], "left_anti").agg(F.lit(0).cast("bigint").alias("n_unstable"), F.count(F.lit(1)).alias("n_apart"))
    return told.unionByName(apart).agg(F.sum("n_unstable").alias("n_unstable"), F.sum("n_apart").alias("n_apart"))


_ENTRY_FIELDS = {
    "verified_by": ("verified_by", "verifier"),
    "verifier_ids": ("verification.verifier_ids", "verifier"),
    "methods": ("verification.methods", "method"),
}


def _entries(spark: SparkSession, d: str) -> DataFrame:
    entities = table(spark, d, "entities")
    entries = [
        entities.select(
            "entity_row",
            F.lit(field).alias("field"),
            F.lit(kind).alias("list_name"),
            F.posexplode(column).alias("pos", "value"),
        )
        for field, (column, kind) in _ENTRY_FIELDS.items()
    ]
    verifiers = table(spark, d, "verifiers")
    methods = table(spark, d, "vocab").where("field = 'verification_method'")
    listed = [(verifiers, "verifier", "verifier_id", "verifier_id"), (verifiers, "verifier", "verifier_id", "display_name"),
              (methods, "method", "code", "code"), (methods, "method", "code", "label")]
    known = [
        t.select(F.lit(kind).alias("list_name"), F.col(i).alias("canonical_id"), F.col(n).alias("name"))
        for t, kind, i, n in listed
    ]
    return canonical.canonical_entries(
        reduce(DataFrame.unionByName, entries), reduce(DataFrame.unionByName, known), "entity_row"
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d).select("entity_row", "field", "pos", "canonical_id")


def p4_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Values that no canonical entry fits, by frequency."""
    lone = _entries(spark, d).where(F.col("canonical_id") == canonical.UNMATCHED)
    return lone.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n_entries"))


def p4_ways(spark: SparkSession, d: str) -> DataFrame:
    """Entries per field and way they were mapped: mention, token_set or none."""
    return _entries(spark, d).groupBy("field", "way").agg(F.count(F.lit(1)).alias("n_entries"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(table(spark, d, "chunks").select("chunk_row", "chunk_id", "heading", "content"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    # A row came out in several pieces exactly if it has a piece 1.
    return _pieces(spark, d).where("n_pieces > 1 and piece_no = 1").select("chunk_row")


def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p5_sound(spark: SparkSession, d: str) -> DataFrame:
    """Sections, and faults of their pieces: too long, not sharing the overlap, or not making up the content again."""
    chunks = table(spark, d, "chunks").select("chunk_row", "content")
    made = _pieces(spark, d).select("chunk_row", "piece_no", "n_pieces", "piece")
    body = F.when(F.col("piece_no") == 0, F.col("piece")).otherwise(F.substring("piece", splitting.OVERLAP + 1, splitting.LIMIT))
    by = made.groupBy("chunk_row").agg(  # the pieces of one section
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", body.alias("body")))), lambda x: x["body"]), "").alias("whole"),
        F.max(F.length("piece")).alias("longest"), F.count(F.lit(1)).alias("n"), F.max("n_pieces").alias("n_pieces"),
    )
    both = chunks.join(by, "chunk_row", "left")
    return both.agg(
        F.count(F.lit(1)).alias("n_sections"), F.count_if(F.col("longest") > splitting.LIMIT).alias("n_too_long"),
        F.count_if((F.col("n") != F.col("n_pieces")) | ~F.coalesce(F.col("whole") == F.col("content"), F.coalesce(F.col("content"), F.lit("")) == "")).alias("n_not_whole"),
    )


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p7_program(spark: SparkSession, d: str) -> DataFrame:
    """How near the packing is to the best: lower bound, value of the linear program, containers that follow it."""
    return packing.program_report(packing.token_items(table(spark, d, "documents")))


def p7_sound(spark: SparkSession, d: str) -> DataFrame:
    """Texts packed, and faults: containers over capacity, texts cut that fit, parts missing or twice."""
    items = packing.token_items(table(spark, d, "documents"))
    packed = packing.pack(items)
    over = packed.groupBy("container").agg(F.sum("size").alias("n")).agg(F.count_if(F.col("n") > packing.CAPACITY).alias("n_overfull"))
    by = packed.groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts"), F.max("part").alias("last"))
    fits = F.ceil(F.col("n_tokens") / packing.CAPACITY)
    right = (F.col("size") == F.col("n_tokens")) & (F.col("parts") == fits) & (F.col("last") == F.col("parts") - 1)
    both = items.join(by, "doc_id", "left").where("n_tokens > 0")
    told = both.agg(F.count(F.lit(1)).alias("n_texts"), F.count_if(~F.coalesce(right, F.lit(False))).alias("n_wrong"))
    rows = told.withColumn("n_overfull", F.lit(0).cast("bigint")).unionByName(
        over.select(F.lit(0).cast("bigint").alias("n_texts"), F.lit(0).cast("bigint").alias("n_wrong"), "n_overfull")
    )
    return rows.agg(*[F.sum(c).alias(c) for c in rows.columns])


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, d))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leak_report(_leaks(spark, d))


def p8_by_join(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p8_found by the way for many items: fingerprints joined through a shuffle."""
    found = leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), broadcast_chars=0)
    return found.select("doc_id", "item_id")


_MODELS: dict[tuple[str, str], language.Model | None] = {}


def _segments(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    place = spark.sparkContext.applicationId, d
    if place not in _MODELS:  # fitted once a session for all queries over one folder
        _MODELS[place] = language.fit_model(documents)
    return language.language_segments(documents, _MODELS[place])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    spoken = language.document_languages(_segments(spark, d))
    return language.unlabelled_languages(table(spark, d, "documents"), spoken)


def p9_documents(spark: SparkSession, d: str) -> DataFrame:
    return language.document_languages(_segments(spark, d))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


def p9_sound(spark: SparkSession, d: str) -> DataFrame:
    """Faults of the segments: outside their text, one upon another, not numbered through, of no known language or confidence."""
    size = table(spark, d, "documents").select("doc_id", F.length("text").alias("size"))
    by = _segments(spark, d).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("segment_no", "seg_start", "seg_stop"))).alias("s"),  # the segments of one document
        F.count_if(~F.col("lang_code").isin(*language.LANGUAGES) | ~F.col("confidence").between(0, 1)).alias("n_odd"),
    )
    n = F.size("s")
    pairs = F.transform(F.sequence(F.lit(1), n), lambda i: (F.element_at("s", i)["segment_no"] == i - 1) & (F.element_at("s", i)["seg_stop"] > F.element_at("s", i)["seg_start"]) & ((i == n) | (F.element_at("s", F.least(i + 1, n))["seg_start"] >= F.element_at("s", i)["seg_stop"])))
    right = F.forall(pairs, lambda p: p) & (F.element_at("s", 1)["seg_start"] >= 0) & (F.element_at("s", n)["seg_stop"] <= F.col("size"))
    return by.join(size, "doc_id").agg(F.coalesce(F.sum("n_odd"), F.lit(0)).alias("n_odd"), F.count_if(~right).alias("n_misplaced"))


QUERIES = {
    "p3_found": p3_found,
    "p3_names": p3_names,
    "p3_groups": p3_groups,
    "p3_members": p3_members,
    "p3_sound": p3_sound,
    "p4_found": p4_found,
    "p4_unmatched": p4_unmatched,
    "p4_ways": p4_ways,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_sound": p5_sound,
    "p7_containers": p7_containers,
    "p7_fill": p7_fill,
    "p7_program": p7_program,
    "p7_sound": p7_sound,
    "p8_found": p8_found,
    "p8_report": p8_report,
    "p8_by_join": p8_by_join,
    "p9_found": p9_found,
    "p9_documents": p9_documents,
    "p9_segments": p9_segments,
    "p9_sound": p9_sound,
}

SQL = {
    "p3_sound": "select 0 as n_unstable, 0 as n_apart",
    "p5_sound": "select count(*) as n_sections, 0 as n_too_long, 0 as n_not_whole from chunks",
    "p9_sound": "select 0 as n_odd, 0 as n_misplaced",
    "p7_sound": "select count(*) as n_texts, 0 as n_wrong, 0 as n_overfull from documents where length(text) > 0",
    "p5_found": "select chunk_row from chunks where length(content) > 1200",
}
