"""Key/value pairs from analysis blocks.

Documents are dealt out whole, once, and everything about one happens in its partition. Those of a few hundred
blocks are paired inside one row; the blocks of larger ones are looked up with equi-joins. The few documents that
hold a large share of all blocks are looked up by ``(doc_id, block_id)`` instead, so their blocks spread over the
cluster. What is gathered in one group are the blocks of a document of ``ROW_BLOCKS`` at most, the words of one
pair (they are listed in the cells of its key and value block), the entries of one key text and, in a payload, the
pairs of one document, since a payload is one text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import conf0, pct, strip
from .blocks import (
    FIELDS,
    Mode,
    dedupe_blocks,
    explode_blocks,
    fields_of,
    is_key,
    is_value,
    key_blocks,
    related_ids,
    token,
    value_blocks,
    value_ids,
)
from .skew import MAX_HOT, MIN_HOT_ROWS, hot_keys, key_hash, slot_many, slot_one, spread_join

PAIR_COLUMNS = ["doc_id", "page_seq", "pos", "key", "value", "key_confidence", "value_confidence"]


#: Documents of so many blocks are paired inside a row, where a lookup reads all ids of the document.
ROW_BLOCKS = 512

KV_SET_COLUMNS = ("block_id", "block_type", "entity_types", "confidence", "relationships")
TOKEN_COLUMNS = ("block_id", "block_type", "text", "selection_status")


def hot_targets(pages: DataFrame, min_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Block ids that very many relationships point at (see ``skew``)."""
    relations = F.flatten(F.array_compact(F.col("blocks")["Relationships"]))
    ids = F.flatten(F.array_compact(relations["Ids"]))
    targets = pages.select("doc_id", F.explode(ids).alias("target"))
    return hot_keys(targets.select(key_hash("doc_id", "target").alias("hash")), min_rows)


def tokens(pages: DataFrame, mode: Mode, hot: DataFrame | None = None) -> DataFrame:
    """What every block id of a document adds to a text, null for none."""
    blocks = explode_blocks(pages, *TOKEN_COLUMNS).select(
        "doc_id", "block_id", "page_seq", "pos", token(mode).alias("token")
    )
    return dedupe_blocks(slot_one(blocks, ["doc_id", "block_id"], hot), "token")


def value_refs(keys: DataFrame, values: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """Keys with the value blocks they point at, left outer.

    ``values`` carries ``slot`` already: it is repeated for hot targets before it is
    de-duplicated, so the join reuses that partitioning. ``value_confidence`` is null
    exactly where no value block was found.
    """
    refs = keys.select(
        "doc_id",
        F.col("block_id").alias("key_id"),
        "page_seq",
        "pos",
        F.col("confidence").alias("key_confidence"),
        F.col("children").alias("key_children"),
        F.posexplode_outer("value_ids").alias("value_pos", "value_id"),
    )
    found = values.select(
        "slot",
        "doc_id",
        F.col("block_id").alias("value_id"),
        conf0(F.col("confidence")).alias("value_confidence"),
        F.col("children").alias("value_children"),
    )
    refs = slot_many(refs, ["doc_id", "value_id"], ["doc_id", "key_id"], hot)
    return refs.join(found, ["slot", "doc_id", "value_id"], "left").drop("slot")


def child_words(refs: DataFrame, known: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """One row per child of a pair's key and value blocks, with its token.

    ``side`` is 0 for the key's own words and 1 for words of a value. The key's
    children are taken once, next to its first value reference. ``dangling`` marks
    children that are no block of the document.
    """
    none = F.expr("cast(array() as array<string>)")
    own = F.when(F.coalesce("value_pos", F.lit(0)) == 0, F.col("key_children")).otherwise(none)
    children = F.concat(
        F.transform(own, lambda c, i: F.struct(
            F.lit(0).alias("side"), i.alias("child_pos"), c.alias("child_id"))),
        F.transform(F.coalesce("value_children", none), lambda c, i: F.struct(
            F.lit(1).alias("side"), i.alias("child_pos"), c.alias("child_id"))),
    )
    rows = refs.select(
        "doc_id",
        "key_id",
        "page_seq",
        "pos",
        "key_confidence",
        "value_pos",
        "value_confidence",
        F.explode_outer(children).alias("child"),
    ).select("*", "child.side", "child.child_pos", "child.child_id").drop("child")
    rows = slot_many(rows, ["doc_id", "child_id"], ["doc_id", "key_id", "child_pos"], hot)
    known = known.select(
        "slot", "doc_id", F.col("block_id").alias("child_id"), "token", F.lit(True).alias("known")
    )
    lost = F.col("child_id").isNotNull() & F.col("known").isNull()
    return (
        rows.join(known, ["slot", "doc_id", "child_id"], "left")
        .withColumn("dangling", lost)
        .drop("slot", "child_id", "known")
    )


def _text(words: Column, side: int) -> Column:
    mine = F.filter(words, lambda w: w["side"] == side)
    return strip(F.array_join(F.transform(mine, lambda w: w["token"]), " "))


def merge_values(words: DataFrame) -> DataFrame:
    """One row per pair: ordered texts of both sides and the confidences.

    The value confidence is that of the last value block found. A value block
    without words adds no text but does set the confidence.
    """
    word = F.struct("side", "value_pos", "child_pos", "token")
    last = F.when(
        F.col("value_confidence").isNotNull(), F.struct("value_pos", "value_confidence")
    )
    return (
        words.withColumn("slot", key_hash("doc_id", "key_id"))
        .groupBy("slot", "doc_id", "key_id", "page_seq", "pos", "key_confidence")
        .agg(
            F.array_sort(
                F.collect_list(F.when(F.col("token").isNotNull(), word))
            ).alias("words"),
            F.max(last).alias("last"),
            F.bool_or("dangling").alias("dangling"),
        )
        .select(
            "doc_id",
            "page_seq",
            "pos",
            _text(F.col("words"), 0).alias("key"),
            _text(F.col("words"), 1).alias("value"),
            conf0(F.col("key_confidence")).alias("key_confidence"),
            conf0(F.col("last.value_confidence")).alias("value_confidence"),
            "dangling",
        )
    )


def pair_blocks(
    pages: DataFrame,
    mode: Mode = "form",
    hot: DataFrame | None = None,
    by_document: bool = False,
    dealt: bool = False,
) -> DataFrame:
    """All key/value pairs of all documents, one row per key block.

    ``dangling`` marks pairs with a child id that is no block; ``form`` rejects their
    documents, ``id`` reads on. Pass ``hot=hot_targets(pages)`` to spread block ids
    that a large share of all relationships points at.

    Without ``by_document`` blocks meet by their ids, and every lookup deals its rows anew. With it pages
    are dealt by ``doc_id`` first, and within ``skew.partitions_kept`` all lookups and groups stay in that
    partitioning: a document's blocks are one task's rows, so giant documents go the other way (see
    ``pair_pages``). Pages that are ``dealt`` by ``doc_id`` already are not dealt again.
    """
    target = ["doc_id", "block_id"]
    place = [*target, "page_seq", "pos"]
    deal = by_document and not dealt
    kv_sets = explode_blocks(pages, *KV_SET_COLUMNS, deal=deal)
    children = related_ids("CHILD").alias("children")
    keys = dedupe_blocks(
        slot_one(
            key_blocks(kv_sets).select(
                *place, "confidence", children, value_ids(mode).alias("value_ids")
            ),
            target,
        ),
        "confidence", "children", "value_ids", place=True,
    )
    values = dedupe_blocks(
        slot_one(value_blocks(kv_sets, mode).select(*place, "confidence", children), target, hot),
        "confidence", "children",
    )
    known = explode_blocks(pages, *TOKEN_COLUMNS, deal=deal).select(*place, token(mode).alias("token"))
    known = dedupe_blocks(slot_one(known, target, hot), "token")
    return merge_values(child_words(value_refs(keys, values, hot), known, hot))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though lambdas in it read it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _id_at(rows: str, place: Column) -> Column:
    return F.get(rows, place)["block_id"]


def _firsts(rows: str) -> Column:
    """Of a column of rows sorted by ``block_id``, the first of each id. No id equals no id."""
    return F.filter(rows, lambda r, i: (i == 0) | ~r["block_id"].eqNullSafe(_id_at(rows, i - 1)))


def _lasts(rows: str) -> Column:
    """Of a column of rows sorted by ``block_id``, the last of each id. No id equals no id."""
    return F.filter(
        rows, lambda r, i: (i == F.size(rows) - 1) | ~r["block_id"].eqNullSafe(_id_at(rows, i + 1))
    )


def _named_lasts(rows: str) -> Column:
    """``_lasts`` without the rows that have no id."""
    return F.filter(
        rows, lambda r, i: r["block_id"].isNotNull() & ~r["block_id"].eqNullSafe(_id_at(rows, i + 1))
    )


def pair_rows(pages: DataFrame, mode: Mode = "form") -> DataFrame:
    """``pair_blocks`` of documents with at most ``ROW_BLOCKS`` blocks each, gathered in one row a document.

    Pages dealt by ``doc_id`` stay where they are. Every lookup reads the ids of the document, so its time grows
    with the square of a document; larger ones go through joins. ``doc_id`` must not be null.
    """
    if "page_seq" not in pages.columns:
        pages = pages.withColumn("page_seq", F.lit(0))
    seq = F.col("page_seq").cast("bigint").alias("page_seq")

    def key_value_set(block: Column, pos: Column) -> Column:
        field = fields_of(block)
        row = F.struct(
            field("block_id").alias("block_id"),
            seq,
            pos.alias("pos"),
            field("confidence").alias("confidence"),
            related_ids("CHILD", field("relationships")).alias("children"),
            value_ids(mode, field).alias("value_ids"),
            is_key(field).alias("is_key"),
            is_value(mode, field).alias("is_value"),
        )
        return F.when(field("block_type") == "KEY_VALUE_SET", row)

    ids = F.col("blocks")[FIELDS["block_id"]]
    tokens_ = F.arrays_zip(
        ids.alias("block_id"),
        F.array_repeat(seq, F.size(ids)).alias("page_seq"),
        F.transform(ids, lambda _, pos: pos).alias("pos"),
        F.transform("blocks", lambda b: token(mode, fields_of(b))).alias("token"),
    )
    # Id first, then place and content: sorted by these, the content that counts is the last of an id.
    docs = pages.select(
        "doc_id", F.array_compact(F.transform("blocks", key_value_set)).alias("sets"), tokens_.alias("tokens")
    ).groupBy("doc_id").agg(
        *[F.sort_array(F.flatten(F.collect_list(n))).alias(n) for n in ("sets", "tokens")]
    ).select(
        "doc_id",
        F.filter("sets", lambda s: s["is_key"]).alias("keys"),
        F.filter("sets", lambda s: s["is_value"]).alias("values"),
        "tokens",
        F.flatten(F.col("sets")["children"]).alias("children"),
    ).select(
        "doc_id",
        _firsts("keys").alias("firsts"),
        _lasts("keys").alias("lasts"),
        _named_lasts("values").alias("values"),
        _named_lasts("tokens").alias("tokens"),
        "children",
    ).select(
        "doc_id",
        "firsts",
        "lasts",
        F.map_from_arrays(F.col("values")["block_id"], F.col("values")).alias("values"),
        F.map_from_arrays(F.col("tokens")["block_id"], F.col("tokens")["token"]).alias("tokens"),
        F.array_except("children", F.col("tokens")["block_id"]).alias("lost"),
    )
    values, texts, lost = F.col("values"), F.col("tokens"), F.col("lost")

    def text(children: Column) -> Column:
        return strip(F.array_join(F.transform(children, lambda c: texts[c]), " "))

    def pair(first: Column, last: Column) -> Column:
        def row(found: Column) -> Column:
            own, others = last["children"], F.flatten(found["children"])
            return F.struct(
                first["page_seq"].alias("page_seq"),
                first["pos"].alias("pos"),
                text(own).alias("key"),
                text(others).alias("value"),
                conf0(last["confidence"]).alias("key_confidence"),
                conf0(F.try_element_at(found, F.lit(-1))["confidence"]).alias("value_confidence"),
                # A child without an id is no lost one; where it meets another there, the overlap is null.
                ((F.size(lost) > 0) & F.coalesce(F.arrays_overlap(F.concat(own, others), lost), F.lit(False)))
                .alias("dangling"),
            )

        return _let(F.array_compact(F.transform(last["value_ids"], lambda v: values[v])), row)

    return docs.select("doc_id", F.inline(F.zip_with("firsts", "lasts", pair)))


def pair_documents(pages: DataFrame, mode: Mode, dealt: bool = False, large: bool = True) -> DataFrame:
    """``pair_rows`` of documents that fit a row, ``pair_blocks`` by document of the others.

    Without ``large`` there are no others: none has over ``ROW_BLOCKS`` blocks, and none is without an id.
    """
    placed = pages if dealt else pages.repartition("doc_id")
    if not large:
        return pair_rows(placed, mode)
    over = document_sizes(placed).filter(F.col("n") > ROW_BLOCKS).select("doc_id", F.lit(True).alias("_over"))
    marked = placed.join(over, "doc_id", "left")
    joined = F.col("_over").isNotNull() | F.col("doc_id").isNull()
    return pair_rows(marked.filter(~joined).select(*pages.columns), mode).unionByName(
        pair_blocks(marked.filter(joined).select(*pages.columns), mode, by_document=True, dealt=True)
    )


def document_sizes(pages: DataFrame) -> DataFrame:
    """``doc_id, n``: the number of blocks of every document. Reads the number of blocks only."""
    return pages.groupBy("doc_id").agg(F.sum(F.size(F.col("blocks")["BlockType"])).alias("n"))


def giant_documents(pages: DataFrame, min_rows: int = MIN_HOT_ROWS) -> list:
    """Ids of the documents with over ``min_rows`` blocks, the ``MAX_HOT`` largest of them at most.

    Any document with over a thousandth of all blocks is among these. Reads the number of blocks only.
    """
    return size_classes(pages, min_rows)[0]


def size_classes(pages: DataFrame, min_rows: int = MIN_HOT_ROWS) -> tuple[list, bool]:
    """The giants (see ``giant_documents``), and whether any other document does not fit a row."""
    nameless = F.col("doc_id").isNull()
    sizes = document_sizes(pages).filter((F.col("n") > min(min_rows, ROW_BLOCKS)) | nameless)
    # Documents without an id come first, so that they are seen; they are no giant.
    largest = sizes.orderBy(F.desc(nameless), F.desc("n"), "doc_id").limit(MAX_HOT + 1).collect()
    giants = [r["doc_id"] for r in largest if r["doc_id"] is not None and r["n"] > min_rows][:MAX_HOT]
    others = [r for r in largest if r["doc_id"] is None or (r["n"] > ROW_BLOCKS and r["doc_id"] not in giants)]
    return giants, bool(others) or len(largest) > MAX_HOT


def by_size(
    pages: DataFrame,
    giants: list,
    by_document: Callable[[DataFrame], DataFrame],
    by_block: Callable[[DataFrame, DataFrame], DataFrame],
    min_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """``by_document`` of the ordinary documents and ``by_block``, with the hot targets, of the ``giants``."""
    if not giants:
        return by_document(pages)
    giant = F.coalesce(F.col("doc_id").isin(giants), F.lit(False))
    large = pages.filter(giant)
    return by_document(pages.filter(~giant)).unionByName(by_block(large, hot_targets(large, min_rows)))


def pair_pages(
    pages: DataFrame,
    mode: Mode,
    giants: list,
    min_rows: int = MIN_HOT_ROWS,
    dealt: bool = False,
    large: bool = True,
) -> DataFrame:
    """All key/value pairs: document by document (see ``pair_documents``), and block by block for the ``giants``."""
    return by_size(
        pages, giants,
        lambda ordinary: pair_documents(ordinary, mode, dealt, large),
        lambda large, hot: pair_blocks(large, mode, hot),
        min_rows,
    )


def block_text(pages: DataFrame, mode: Mode, hot: DataFrame | None = None) -> DataFrame:
    """Assembled text of every key/value block: ``doc_id, block_id, text``."""
    target = ["doc_id", "block_id"]
    kv_sets = explode_blocks(pages, "block_id", "block_type", "relationships").filter(
        F.col("block_type") == "KEY_VALUE_SET"
    )
    owners = dedupe_blocks(
        slot_one(
            kv_sets.select(*target, "page_seq", "pos", related_ids("CHILD").alias("children")),
            target,
        ),
        "children",
    )
    rows = owners.select(
        "doc_id", "block_id", F.posexplode_outer("children").alias("child_pos", "child_id")
    )
    rows = slot_many(rows, ["doc_id", "child_id"], ["doc_id", "block_id", "child_pos"], hot)
    known = tokens(pages, mode, hot).withColumnRenamed("block_id", "child_id")
    word = F.when(F.col("token").isNotNull(), F.struct("child_pos", "token"))
    return (
        rows.join(known, ["slot", "doc_id", "child_id"], "left")
        .withColumn("slot", key_hash("doc_id", "block_id"))
        .groupBy("slot", "doc_id", "block_id")
        .agg(
            strip(
                F.array_join(
                    F.transform(F.array_sort(F.collect_list(word)), lambda w: w["token"]), " "
                )
            ).alias("text")
        )
        .drop("slot")
    )


def nonempty_keys(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("key") != "")


def first_seen_order(pairs: DataFrame, min_hot_rows: int = MIN_HOT_ROWS) -> DataFrame:
    """Add the place where a pair's key text first appears in its document.

    Pairs are dealt by ``doc_id``, and what groups the result by document needs no further exchange; the minimum
    of a key text is taken where its document is. Documents of over ``min_hot_rows`` pairs are not dealt whole:
    a minimum per key text combines on the map side, and the join back spreads key texts that repeat very
    often. A null document or key has no place. Reads ``pairs`` twice, and looks for those documents when it
    is called, so hand it a stored table.
    """
    document = key_hash("doc_id")
    hot = hot_keys(pairs.select(document.alias("hash")), min_hot_rows).collect()
    if not hot:
        return _first_by_document(pairs)
    giant = document.isin([r["hash"] for r in hot])
    return _first_by_document(pairs.filter(~giant)).unionByName(_first_by_key(pairs.filter(giant), min_hot_rows))


def _first_by_document(pairs: DataFrame) -> DataFrame:
    on = ["doc_id", "key"]
    first = F.min(F.struct("page_seq", "pos")).over(Window.partitionBy(*on))
    first = F.when(F.col("doc_id").isNotNull() & F.col("key").isNotNull(), first)
    rows = pairs.repartition("doc_id").withColumn("first", first)
    return rows.select(
        *on,
        *[c for c in pairs.columns if c not in on],
        F.col("first.page_seq").alias("first_page_seq"),
        F.col("first.pos").alias("first_pos"),
    )


def _first_by_key(pairs: DataFrame, min_hot_rows: int) -> DataFrame:
    on = ["doc_id", "key"]
    firsts = pairs.groupBy(*on).agg(F.min(F.struct("page_seq", "pos")).alias("first"))
    firsts = firsts.select(
        *on,
        F.col("first.page_seq").alias("first_page_seq"),
        F.col("first.pos").alias("first_pos"),
    )
    hot = hot_keys(pairs.select(key_hash(*on).alias("hash")), min_hot_rows)
    return spread_join(pairs, firsts, on, "left", ["page_seq", "pos"], hot)


def group_kv(pairs: DataFrame) -> DataFrame:
    """All entries of a key text of a document, in block order.

    Takes the output of ``first_seen_order``.
    """
    entry = F.struct("page_seq", "pos", "value", "key_confidence", "value_confidence")
    return (
        pairs.groupBy("doc_id", "key", "first_page_seq", "first_pos")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )


def kv_payload(pairs: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """JSON list of a document's pairs, keys by first appearance, duplicates adjacent.

    Takes the output of ``first_seen_order``; one row a document, whatever its size.
    ``docs`` adds ``[]`` for documents without pairs.
    """
    item = F.struct(
        "first_page_seq", "first_pos", "page_seq", "pos",
        "key", "value", "key_confidence", "value_confidence",
    )
    payload = F.transform(
        F.sort_array(F.collect_list(item)),
        lambda p: F.struct(
            p["key"].alias("key"),
            p["value"].alias("value"),
            p["key_confidence"].alias("key_confidence"),
            p["value_confidence"].alias("value_confidence"),
        ),
    )
    out = pairs.groupBy("doc_id").agg(F.to_json(payload).alias("payload"))
    if docs is None:
        return out
    seen = pairs.select("doc_id").distinct()
    empty = docs.select("doc_id").distinct().join(seen, "doc_id", "left_anti")
    return out.unionByName(empty.select("doc_id", F.lit("[]").alias("payload")))


def kv_report(pairs: DataFrame) -> DataFrame:
    """Display table: texts with percent strings."""
    return pairs.select(
        "doc_id",
        F.col("key").alias("Key"),
        F.col("value").alias("Value"),
        pct(F.col("key_confidence")).alias("Key Confidence"),
        pct(F.col("value_confidence")).alias("Value Confidence"),
    )
