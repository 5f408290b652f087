"""Response corpora derived from the relational test tables.

The tables hold no saved responses, so the registered queries derive them here, and
their SQL counterparts compute the answers straight from the tables. Every block and
every model answer is built inside the row it comes from. Image records gather events,
at most ``EVENTS_PER_IMAGE`` each, because an image covers a range of event ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import types

EVENTS_PER_IMAGE = 65536
#: Spread rows go to a task in so many, so tasks do not grow with a table.
ROWS_PER_TASK = 100_000
#: Scans read so many in a task: what a task hands to a shuffle of over 200 tasks is held in its memory.
ROWS_PER_SCAN = 1_000_000

_MIN_SCANS = "spark.sql.files.minPartitionNum"


@contextmanager
def split_scans(spark: SparkSession, rows: int) -> Iterator[None]:
    """While a job runs in here, a scan of ``rows`` rows has more tasks the more rows there are.

    The setting is read when a scan starts and put back afterwards.
    """
    before = spark.conf.get(_MIN_SCANS, None)
    scans = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_SCAN))
    spark.conf.set(_MIN_SCANS, str(scans))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_MIN_SCANS)
        else:
            spark.conf.set(_MIN_SCANS, before)


def spread(df: DataFrame, rows: int, spread_by: tuple[str, ...]) -> DataFrame:
    """``rows`` rows dealt by columns: over all cores, and over more tasks the more rows there are."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    return df.repartition(tasks, *spread_by)


def table(spark: SparkSession, sf_dir: str, name: str, spread_by: tuple[str, ...] = ()):
    """A test table. With ``spread_by`` its rows are first spread over the cores.

    Rows grow into many blocks each, so a table of one file would keep all of that work
    in one task.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, df.count(), spread_by) if spread_by else df



_RELATIONSHIPS = "array<struct<Type:string,Ids:array<string>>>"


def _block_of(id_, kind, types_, conf, text, status, rels) -> Column:
    return F.struct(
        id_.alias("Id"),
        kind.alias("BlockType"),
        types_.alias("EntityTypes"),
        conf.alias("Confidence"),
        text.alias("Text"),
        status.alias("SelectionStatus"),
        rels.alias("Relationships"),
    )


def _block(id_, kind, types_=None, conf=None, text=None, status=None, rels=None) -> Column:
    null = F.lit(None)
    return _block_of(
        id_,
        F.lit(kind),
        F.array(*map(F.lit, types_)) if types_ else null.cast("array<string>"),
        conf if conf is not None else null.cast("double"),
        text if text is not None else null.cast("string"),
        status if status is not None else null.cast("string"),
        rels if rels is not None else null.cast(_RELATIONSHIPS),
    )


def _rel(kind: str, *ids: Column) -> Column:
    return F.struct(F.lit(kind).alias("Type"), F.array(*ids).alias("Ids"))


def line_pages(lineitem: DataFrame, rows: int) -> DataFrame:
    """Form pages of orders: a document per order, a page with one key/value pair per line.

    The lines, ``rows`` of them, are dealt by ``doc_id`` while they are still narrow, so pages are made where
    their document's other pages are.

    Lines with a quantity up to 3 have no value, those up to 6 point at a missing value
    block first. All pages of an order repeat the word ``LINE``. Some orders have dangling
    children, untyped blocks, failed or running jobs. Every page has the same number of
    blocks, one that is not wanted repeats the word ``N``: a plain array of structs lets
    Catalyst compute only the fields a query reads.
    """
    key = F.concat_ws(
        "-", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("bigint"), "l_returnflag", "l_linestatus",
    )

    def bid(letter: str) -> Column:
        return F.concat(F.lit(letter), F.col("k"))

    def hundredths(n: Column) -> Column:
        return (n % 10000).cast("double") / 100

    dealt = lineitem.withColumn("doc_id", F.col("l_orderkey").cast("string"))
    base = spread(dealt, rows, ("doc_id",)).select(
        "doc_id",
        key.alias("k"),
        (F.col("l_partkey") * 8 + F.col("l_linenumber")).alias("page_seq"),
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_returnflag", "l_linestatus",
    )
    quantity = F.col("l_quantity")
    first_value = F.when(quantity <= 6, bid("X")).otherwise(bid("V"))
    last_word = F.when(F.col("l_orderkey") % 97 == 0, bid("Z")).otherwise(bid("B"))
    own_words = _rel("CHILD", F.lit("LINE"), bid("N"))
    number = F.col("l_linenumber").cast("string")
    flags = F.concat("l_returnflag", "l_linestatus")

    def optional(wanted: Column, letter: str, kind: str, types_=None, conf=None, text=None,
                 rels=None) -> Column:
        """The block if wanted, else the word ``N`` once more, decided field by field."""
        null = F.lit(None)
        return _block_of(
            F.when(wanted, bid(letter)).otherwise(bid("N")),
            F.when(wanted, F.lit(kind)).otherwise(F.lit("WORD")),
            F.when(wanted, F.array(*map(F.lit, types_))) if types_ else null.cast("array<string>"),
            F.when(wanted, conf) if conf is not None else null.cast("double"),
            F.when(wanted, text if text is not None else null.cast("string")).otherwise(number),
            null.cast("string"),
            F.when(wanted, rels) if rels is not None else null.cast(_RELATIONSHIPS),
        )

    blocks = F.array(
        _block(
            bid("K"), "KEY_VALUE_SET", ["KEY"],
            hundredths(F.col("l_orderkey") * 7 + F.col("l_partkey")),
            rels=F.when(quantity <= 3, F.array(own_words)).otherwise(
                F.array(_rel("VALUE", first_value, bid("W")), own_words)
            ),
        ),
        _block(
            bid("V"), "KEY_VALUE_SET", ["VALUE"],
            hundredths(F.col("l_suppkey") * 13 + F.col("l_linenumber")),
            rels=F.array(_rel("CHILD", bid("A"), bid("S"), last_word)),
        ),
        optional(
            F.col("l_suppkey") % 5 != 0, "W", "KEY_VALUE_SET", ["VALUE"],
            hundredths(F.col("l_suppkey") * 17 + F.col("l_linenumber")),
            rels=F.array(_rel("CHILD", bid("C"))),
        ),
        optional(
            (F.col("l_orderkey") % 89 == 5) & (F.col("l_linenumber") == 1), "U", "KEY_VALUE_SET"
        ),
        _block(F.lit("LINE"), "WORD", text=F.lit("Line")),
        _block(bid("N"), "WORD", text=number),
        _block(bid("A"), "WORD", text=flags),
        _block(
            bid("S"), "SELECTION_ELEMENT",
            status=F.when(F.col("l_linestatus") == "O", "SELECTED").otherwise("NOT_SELECTED"),
        ),
        _block(bid("B"), "WORD", text=F.concat(F.lit("P"), F.col("l_partkey").cast("string"))),
        _block(bid("C"), "WORD", text=F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))),
        # The same id once more: the last content counts.
        optional(
            F.col("l_partkey") % 10 == 3, "A", "WORD", text=F.concat(F.lit("re"), flags)
        ),
    )
    status = (
        F.when(F.col("l_orderkey") % 50 == 7, "FAILED")
        .when(F.col("l_orderkey") % 50 == 9, "IN_PROGRESS")
        .otherwise("SUCCEEDED")
    )
    return base.select(
        "doc_id",
        F.concat(F.lit("job-"), "doc_id").alias("job_id"),
        "page_seq",
        status.alias("job_status"),
        F.when(F.col("l_orderkey") % 100 == 7, "bad scan").alias("status_message"),
        blocks.alias("blocks"),
    )


def form_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of all orders, dealt by ``doc_id``."""
    lines = table(spark, sf_dir, "lineitem")
    return line_pages(lines, lines.count())


def id_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same blocks read as licences; every page counts, no job status."""
    return form_pages(spark, sf_dir).select("doc_id", "page_seq", "blocks")


def order_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poll records of a job per customer: an order is one poll, the latest decides."""
    status = (
        F.when(F.col("o_orderstatus") == "F", "SUCCEEDED")
        .when(F.col("o_orderstatus") == "P", "FAILED")
        .otherwise("IN_PROGRESS")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("doc_id"),
        F.concat(F.lit("job-"), F.col("o_custkey").cast("string")).alias("job_id"),
        F.col("o_orderkey").alias("page_seq"),
        status.alias("job_status"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).alias("status_message"),
    )


def image_records(
    spark: SparkSession, sf_dir: str, events_per_image: int = EVENTS_PER_IMAGE
) -> DataFrame:
    """Image records from the events of a user within a range of event ids."""
    k = F.get_json_object("props", "$.k").cast("int")
    eid = F.col("event_id")
    kind = F.col("event_type")
    no_string = F.lit(None).cast("string")

    def hundredths(n: Column) -> Column:
        return (n % 10000).cast("double") / 100

    label = F.struct(
        kind.alias("Name"),
        ((F.least(F.round(F.col("value") * 100), F.lit(5000.0)) + 5000) / 100).alias("Confidence"),
        F.when(
            eid % 4 != 0,
            F.array(
                F.struct(F.concat(F.lit("Cat"), (eid % 3).cast("string")).alias("Name")),
                F.struct(F.lit("Any").alias("Name")),
            ),
        ).alias("Categories"),
    )
    color = F.when(
        kind == "signup",
        F.struct(
            F.when(eid % 3 != 0, F.concat(F.lit("Color"), (eid % 11).cast("string"))).alias(
                "SimplifiedColor"
            ),
            F.when(eid % 6 != 0, F.concat(F.lit("css"), (eid % 17).cast("string"))).alias(
                "CSSColor"
            ),
            F.when(eid % 4 != 0, F.concat(F.lit("#"), eid.cast("string"))).alias("HexCode"),
            F.when(eid % 5 != 0, hundredths(eid * 29)).alias("PixelPercent"),
        ),
    )
    text = F.when(
        kind.isin("click", "view"),
        F.struct(
            F.concat(F.lit("T"), eid.cast("string")).alias("DetectedText"),
            F.when(eid % 2 == 0, "LINE").otherwise("WORD").alias("Type"),
            hundredths(eid * 37).alias("Confidence"),
            F.when(
                eid % 13 != 0,
                F.struct(
                    F.struct(
                        (k.cast("double") / 1000).alias("Width"),
                        (k.cast("double") / 100).alias("Height"),
                    ).alias("BoundingBox")
                ),
            ).alias("Geometry"),
        ),
    )
    emotion_names = ["CALM", "HAPPY", "SAD", "ANGRY", "FEAR"]
    emotions = F.array(
        *[
            F.struct(
                F.element_at(
                    F.array(*map(F.lit, emotion_names)), (F.pmod(eid + i, F.lit(5)) + 1).cast("int")
                ).alias("Type"),
                hundredths(eid * 7 + i).alias("Confidence"),
            )
            for i in range(5)
        ]
    )
    face = F.when(
        kind == "purchase",
        F.struct(
            hundredths(eid * 53).alias("Confidence"),
            F.when(eid % 7 != 0, F.struct(k.alias("Low"), (k + 10).alias("High"))).alias(
                "AgeRange"
            ),
            F.when(
                eid % 5 != 0,
                F.struct(F.when(eid % 2 == 0, "Male").otherwise("Female").alias("Value")),
            ).alias("Gender"),
            F.when(eid % 9 != 0, emotions).alias("Emotions"),
        ),
    )
    detection = F.struct(
        eid.alias("i"), label.alias("l"), color.alias("c"), text.alias("t"), face.alias("f")
    )
    number = F.floor(F.col("event_id") / events_per_image)
    images = (
        table(spark, sf_dir, "events", ("event_id",))
        .groupBy("user_id", number.alias("number"))
        .agg(F.array_sort(F.collect_list(detection)).alias("d"))
    )
    image_id = F.concat_ws("-", F.col("user_id").cast("string"), F.col("number").cast("string"))

    def every(field: str) -> Column:
        return F.transform(
            F.filter("d", lambda x: x[field].isNotNull()), lambda x: x[field]
        )

    colors = every("c")
    return images.select(
        F.concat(F.lit("C"), image_id).alias("case_id"),
        image_id.alias("image_id"),
        every("l").alias("Labels"),
        F.when(
            F.size(colors) > 0, F.struct(F.struct(colors.alias("DominantColors")).alias("Foreground"))
        ).alias("ImageProperties"),
        every("t").alias("TextDetections"),
        every("f").alias("FaceDetails"),
    )


def licence_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case per customer, and a licence result for the cases with an even key."""
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit("-0")).alias("case_id"),
        F.col("c_custkey").cast("string").alias("doc_id"),
        (F.col("c_custkey") % 2 == 0).alias("landed"),
        "c_name",
    )


def licence_results(spark: SparkSession, sf_dir: str, landed_only: bool = False) -> DataFrame:
    """One-page licence results; every tenth one holds no key text."""
    cases = licence_cases(spark, sf_dir)
    if landed_only:
        cases = cases.filter("landed")
    number = F.col("doc_id").cast("bigint")
    blocks = F.array(
        _block(
            F.lit("K"), "KEY_VALUE_SET", ["KEY"], (number % 10000).cast("double") / 100,
            rels=F.when(
                number % 10 == 0, F.array(_rel("VALUE", F.lit("V")))
            ).otherwise(F.array(_rel("VALUE", F.lit("V")), _rel("CHILD", F.lit("KW")))),
        ),
        _block(
            F.lit("V"), "KEY_VALUE_SET", ["VALUE"], (number * 3 % 10000).cast("double") / 100,
            rels=F.array(_rel("CHILD", F.lit("VW"))),
        ),
        _block(F.lit("KW"), "WORD", text=F.lit("Name")),
        _block(F.lit("VW"), "WORD", text=F.col("c_name")),
    )
    return cases.select(
        "case_id", "doc_id", F.lit(0).cast("bigint").alias("page_seq"), blocks.alias("blocks")
    )


# SQL texts that Spark and the checking database both read, so that both sides start
# from the same answers.
ANSWER_JSON = """
'{"header":{"application_date":"'
|| CASE WHEN c_custkey % 61 = 0 THEN '1/2/2024' ELSE '13/45/2024' END
|| '"},"agency_info":{"email":"'
|| CASE WHEN c_custkey % 59 = 0 THEN 'no mail'
        ELSE 'a' || CAST(c_custkey AS STRING) || '@example.com' END
|| '"},"transaction_info":{"status":"'
|| CASE c_mktsegment WHEN 'BUILDING' THEN 'QUOTE' WHEN 'HOUSEHOLD' THEN 'RENEW'
        WHEN 'MACHINERY' THEN 'CHANGE' WHEN 'AUTOMOBILE' THEN 'CANCEL' ELSE c_mktsegment END
|| '","unknown":1},'
|| CASE WHEN c_custkey % 23 = 0 THEN ''
        ELSE '"policy_term":{"deposit":' || CAST(c_acctbal AS STRING) || '},' END
|| '"named_insureds":'
|| CASE WHEN c_custkey % 29 = 0 THEN '[]'
        WHEN c_custkey % 31 = 0 THEN '[{"name":null}]'
        WHEN c_custkey % 37 = 0 THEN '[{"website":"x"}]'
        ELSE '[{"name":"' || c_name || '","fein_or_ssn":"'
             || CASE WHEN c_custkey % 41 = 0 THEN 'x12-3456789'
                     WHEN c_custkey % 5 = 0 THEN '12-3456789 junk' ELSE '123-45-6789' END
             || '"}]' END
|| ',"premises_information":[{"zip":"12345-6789"},{"state":"'
|| CASE WHEN c_custkey % 53 = 0 THEN 'ca' ELSE 'CA' END || '","zip":"'
|| CASE WHEN c_custkey % 47 = 0 THEN '1234' ELSE lpad(CAST(c_custkey AS STRING), 5, '0') END
|| '","num_employees_full_time":"' || CAST(c_custkey % 90 AS STRING)
|| '.0"}],"general_information":{"subsidiary_details":{"percent_owned":'
|| CAST(c_custkey % 103 AS STRING) || '}},"loss_history":{"years_checked":'
|| CASE WHEN c_custkey % 2 = 0 THEN '"' || CAST(c_custkey % 12 AS STRING) || '"'
        ELSE CAST(c_custkey % 12 AS STRING) END
|| ',"no_losses":'
|| CASE WHEN c_custkey % 67 = 0 THEN '"X"' WHEN c_custkey % 2 = 0 THEN '"Yes"' ELSE 'true' END
|| '}' || CASE WHEN c_custkey % 43 = 0 THEN ',"extra_note":"x"' ELSE '' END || '}'
"""

ANSWER_TEXT = """
CASE c_custkey % 7
  WHEN 0 THEN json
  WHEN 1 THEN '```json' || chr(10) || json || chr(10) || '```'
  WHEN 2 THEN '```' || json || '```'
  WHEN 3 THEN json || ' thanks'
  WHEN 4 THEN CASE WHEN c_custkey % 2 = 0
    THEN '{' || chr(10) || '"n": ' || CAST(c_custkey AS STRING) || ',' || chr(10)
         || '"b": oops,' || chr(10) || '"c": 1' || chr(10) || '}'
    ELSE substr(json, 1, length(json) - 2) END
  WHEN 5 THEN chr(160) || chr(10) || json || chr(9) || ' '
  ELSE CASE WHEN c_custkey % 2 = 0 THEN '[1]' ELSE json END END
"""

EVENT_JSON = """
'{"event":{"id":' || CAST(event_id AS STRING) || ',"props":' || props
|| ',"flags":[["' || event_type || '",' || CAST(user_id AS STRING) || '],[],[{}]]},"note":null,'
|| '"even":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END
|| ',"deep":{"a":{"b":[[{"c":{"d":[' || CAST(user_id AS STRING) || ',1.50,null,{}]}}]]}}'
|| ',"a.b":"' || event_type || '","list":[{"half":' || CAST(event_id AS STRING) || '.5},"x"]}'
"""


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved model response per customer: fenced, padded, cut off, chatty or plain."""
    text = (
        table(spark, sf_dir, "customer", ("c_custkey",))
        .withColumn("json", F.expr(ANSWER_JSON))
        .withColumn("text", F.expr(ANSWER_TEXT))
    )
    body = F.when(F.col("c_custkey") % 71 == 0, F.lit('{"error":"busy"}')).otherwise(
        F.to_json(F.struct(F.array(F.struct("text")).alias("content")))
    )
    return text.select(
        F.col("c_custkey").cast("string").alias("doc_id"),
        F.sha2(F.col("c_name"), 256).alias("prompt_sha"),
        body.alias("body"),
    )


def segment_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt per customer; customers of one segment and nation share theirs."""
    prompt = F.concat(F.lit("ask "), "c_mktsegment", F.lit(" "), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("doc_id"), prompt.alias("prompt")
    )


def saved_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of an earlier run: prompts of some nations, failed calls, and foreign prompts."""
    customers = table(spark, sf_dir, "customer")
    nation = F.col("c_nationkey")
    text = F.concat(
        F.when(nation % 5 == 4, F.lit("other ")).otherwise(F.lit("ask ")),
        "c_mktsegment", F.lit(" "), nation.cast("string"),
    )
    saved = F.to_json(F.struct(F.array(F.struct(F.lit("saved").alias("text"))).alias("content")))
    return customers.filter(nation % 5 != 0).select(
        F.col("c_custkey").cast("string").alias("doc_id"),
        F.sha2(text, 256).alias("prompt_sha"),
        F.when(nation % 5 != 1, saved).alias("body"),
    )


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", ("event_id",)).select(
        F.col("event_id").cast("string").alias("doc_id"),
        F.try_parse_json(F.expr(EVENT_JSON)).alias("v"),
    )


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON line of a page per order; some are torn, wrongly typed or blank."""
    key = F.col("o_orderkey")
    line = F.to_json(
        F.struct(
            F.concat(F.lit("O"), key.cast("string")).alias("doc_id"),
            F.lit("j").alias("job_id"),
            F.lit(0).cast("bigint").alias("page_seq"),
            F.lit("SUCCEEDED").alias("job_status"),
        )
    )
    torn = F.substring(line, 1, 5)
    typed = F.replace(line, F.lit('"page_seq":0'), F.lit('"page_seq":"first"'))
    value = (
        F.when(key % 10 == 3, torn).when(key % 10 == 6, typed).when(key % 10 == 7, F.lit(" "))
        .otherwise(line)
    )
    return table(spark, sf_dir, "orders").select(value.alias("value"))


def order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as they stand on a form; some are no calendar date."""
    key = F.col("o_orderkey")
    text = (
        F.when(key % 10 == 3, F.lit("02/30/2024")).when(key % 10 == 6, F.lit("soon"))
        .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy"))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("written"))


def image_feeds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three feeds of one image a customer; customers by turn lack some of them."""
    images = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("I"), F.col("c_custkey").cast("string")).alias("image_id"), "c_custkey"
    )
    held = {"labels": F.col("c_custkey") % 5 != 1, "text": F.col("c_custkey") % 3 != 1,
            "faces": F.col("c_custkey") % 7 != 1}
    return tuple(images.filter(there).select("image_id") for there in held.values())


def landed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listings with a path and a modification time per event."""
    return table(spark, sf_dir, "events").select(
        F.format_string("/in/u%d/doc_%d.pdf", "user_id", "event_id").alias("path"),
        F.col("ts").alias("modificationTime"),
    )


def job_landings(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Pages of a job per customer, an order each, in three landings, and one page long after them.

    Some jobs fail, some never end, and some lack a page they promise.
    """
    orders = table(spark, sf_dir, "orders")
    sizes = orders.groupBy("o_custkey").agg(F.count_distinct("o_orderkey").alias("n"))
    key = F.col("o_custkey")
    status = F.when(key % 10 == 3, "FAILED").when(key % 10 == 6, "IN_PROGRESS").otherwise("SUCCEEDED")
    word = _block(F.lit("w"), "WORD", text=F.col("o_orderpriority"))
    pages = orders.join(sizes, "o_custkey").select(
        key.cast("string").alias("doc_id"),
        F.concat(F.lit("job-"), key.cast("string")).alias("job_id"),
        F.col("o_orderkey").alias("page_seq"),
        status.alias("job_status"),
        F.lit(None).cast("string").alias("status_message"),
        F.array(word).alias("blocks"),
        (F.col("n") + (key % 7 == 2).cast("int")).alias("page_count"),
    )

    def at(hours: int) -> Column:
        return F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hours)).alias("landed_at")

    last = pages.limit(1).select(
        F.lit("~").alias("doc_id"), F.lit("~").alias("job_id"), F.lit(0).cast("bigint").alias("page_seq"),
        F.lit("IN_PROGRESS").alias("job_status"), "status_message", "blocks", "page_count", at(1000),
    )
    return [pages.filter(F.col("page_seq") % 3 == i).select("*", at(i)) for i in range(3)] + [last]


def feed_landings(spark: SparkSession, sf_dir: str) -> dict[str, list[DataFrame]]:
    """The feeds of the image records apart, each landing at an hour of its own, some of them never.

    The last landing is an image of its own, long after the others.
    """
    records = image_records(spark, sf_dir)
    user = F.substring_index("image_id", "-", 1).cast("bigint")
    out = {}
    for hour, (name, lost) in enumerate({"labels": user % 5 == 1, "text": user % 3 == 1, "faces": user % 7 == 1}.items()):
        fields = [f.split()[0] for f in types.IMAGE_FEEDS[name].replace(", ", ",").split(",") if " " in f]
        columns = [c for c in records.columns if c in fields]
        at = F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hour)).alias("landed_at")
        late = F.timestamp_seconds(F.lit(1_800_000_000)).alias("landed_at")
        out[name] = [
            records.filter(~lost).select(*columns, at),
            records.limit(1).withColumn("image_id", F.lit("~")).select(*columns, late),
        ]
    return out


# A table of addresses by a remainder: text, and whether it is one.
ADDRESSES = [
    ("a{n}@example.com", True), ("first.last+tag@mail-{n}.example.co", True), ("x_{n}@b.cd", True),
    ("no mail {n}", False), ("a{n}@b", False), ("a{n}@@b.cd", False), (".a{n}@b.cd", False), ("a..b{n}@c.de", False),
    ("a{n}@-b.cd", False), ("a{n}@b-.cd", False), ("a{n}@b..cd", False), ("a{n}@b.12", False), ("a{n}@b_c.de", False),
    ("ü{n}@größe.de", True), ("{n}@1-2.io", True), ("a b{n}@c.de", False), ("@b{n}.cd", False), ("a{n}@", False),
]


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An e-mail address per customer, many of them wrong in one way."""
    key = F.col("c_custkey")
    texts = F.array(*[F.lit(t) for t, _ in ADDRESSES])
    text = F.replace(F.get(texts, (key % len(ADDRESSES)).cast("int")), F.lit("{n}"), key.cast("string"))
    long = key % 97 == 5
    text = F.when(long, F.concat(F.repeat(F.lit("a"), F.lit(64) + (key % 2).cast("int")), F.lit("@b.cd"))).otherwise(text)
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("address"))
