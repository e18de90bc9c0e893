"""Preparing schema and vocabulary context for many questions at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.contains import contains_pairs
from palisade.functions.within import first_items, first_within
from palisade.session import materialize


def schema_text(catalog: DataFrame, remarks: DataFrame) -> DataFrame:
    """One text per table: its name and comment, then each column with type and comment.

    `remarks`: schema_name, table_name, column_name ('' for the table), remark.
    """
    keys = ["schema_name", "table_name"]
    on_columns = remarks.filter(F.col("column_name") != "").withColumnRenamed("remark", "__column_remark")
    on_tables = remarks.filter(F.col("column_name") == "").select(*keys, F.col("remark").alias("__table_remark"))
    suffix = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(", "), F.col(c))).otherwise("")
    entry = F.concat(F.lit("("), "column_name", F.lit(":"), "data_type", suffix("__column_remark"), F.lit(")"))
    fields = (
        catalog.join(on_columns, [*keys, "column_name"], "left")
        .withColumn("__entry", entry)
        .groupBy(*keys)
        .agg(F.expr("listagg(__entry, ',\n') WITHIN GROUP (ORDER BY ordinal)").alias("__fields"))
    )
    return fields.join(on_tables, keys, "left").select(
        *keys,
        F.concat(
            F.lit("# Table: "), "table_name", suffix("__table_remark"), F.lit("\n[\n"), "__fields", F.lit("\n]\n")
        ).alias("schema_text"),
    )


def _parts(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"(?U)[_\s]+"), lambda p: p != ""))


BEST_TABLES = 20
# Pairs of keyword list and table that one task holds while it scores them, and of question and table that one gives out.
PAIRS_PER_TASK = 500_000
# Beyond it a task gives out more pairs; it holds none of them.
MOST_TASKS = 20_000
_KINDS = {"name": 1, "comment": 2, "in_comment": 4, "part": 8, "note": 16, "in_note": 32, "field": 64}


def keyword_scores(tables: DataFrame, fields: DataFrame, keywords: DataFrame, unnamed: bool = False) -> DataFrame:
    """Score of each (question, table) that any keyword touches; other pairs score 0 and are absent.

    `tables`: table_id, name, comment; `fields`: table_id, field_name, comment; `keywords`:
    question_id, keyword (repeats count). Distinct keywords are matched to tables first, by equality or
    through the phrase search, and each distinct list of keywords is scored once. A list's tables and its
    questions then meet as packs, so one list of many questions and tables is spread over all tasks.
    `unnamed`: the rows without a question_id count as one question more, instead of being left out.
    """
    listed, lists = _keyword_lists(keywords if unnamed else keywords.filter(F.col("question_id").isNotNull()))
    scored, pairs = _scores(tables, fields, lists)
    side = math.isqrt(max(1, PAIRS_PER_TASK // 8))
    slots = lambda n: max(1, -(-n // side))
    slot = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).alias("slot")
    tables_packed = (
        scored.groupBy("list", slot("table_id", slots(tables.count())))
        .agg(F.collect_list(F.struct("table_id", "score")).alias("tables"))
        .drop("slot")
    )
    asked_packed = (
        listed.groupBy("list", slot("question_id", slots(lists.agg(F.max("questions")).first()[0] or 0)))
        .agg(F.collect_list(F.struct("question_id")).alias("asked"))
        .drop("slot")
    )
    tasks = max(tables.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, -(-pairs // PAIRS_PER_TASK)))
    met = tables_packed.join(asked_packed, "list").select("tables", "asked").repartition(tasks)
    each = met.select("asked", F.explode("tables").alias("t")).select(F.explode("asked").alias("q"), "t")
    return each.select("q.question_id", "t.table_id", "t.score")


def _keyword_lists(keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(question_id, list) of each question with a keyword, a list going by a digest; and, written, (list, words, questions) of each list."""
    asked = keywords.select("question_id", F.lower(F.trim("keyword")).alias("keyword")).filter(F.col("keyword") != "")
    words = asked.groupBy("question_id").agg(F.array_sort(F.collect_list("keyword")).alias("words"))
    listed = words.withColumn("list", F.unhex(F.substring(F.sha2(F.to_json("words"), 256), 1, 32)))
    lists = listed.groupBy("list").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("questions"))
    return listed.select("question_id", "list"), materialize(lists, "keyword-lists")


def _keyword_matches(tables: DataFrame, fields: DataFrame, words: DataFrame) -> DataFrame:
    """(keyword, table_id, bit): what of a table or its fields a keyword meets, one row for each."""

    def kind(df: DataFrame, name: str) -> DataFrame:
        return df.select("keyword", "table_id", F.lit(_KINDS[name]).alias("bit"))

    comments = tables.filter(F.col("comment") != "").select("comment").distinct()
    notes = fields.filter(F.col("comment") != "").select("comment").distinct()
    in_comments = _within(comments, words)
    in_notes = _within(notes, words)
    return (
        kind(tables.withColumn("keyword", F.col("name")).join(words, "keyword"), "name")
        .unionByName(kind(tables.withColumn("keyword", F.col("comment")).join(words, "keyword"), "comment"))
        .unionByName(kind(in_comments.join(tables, "comment"), "in_comment"))
        .unionByName(kind(tables.select("table_id", F.explode(_parts(F.col("name"))).alias("keyword")).join(words, "keyword"), "part"))
        .unionByName(kind(fields.withColumn("keyword", F.col("comment")).join(words, "keyword"), "note"))
        .unionByName(kind(in_notes.join(fields, "comment"), "in_note"))
        .unionByName(kind(fields.select("table_id", F.explode(_parts(F.col("field_name"))).alias("keyword")).join(words, "keyword"), "field"))
    )


def _scores(tables: DataFrame, fields: DataFrame, lists: DataFrame) -> tuple[DataFrame, int]:
    """(list, table_id, score) of the tables that a keyword of a list touches; and how many pairs of question and match that makes.

    Matches are written and their pairs with lists counted, then dealt by table so that a task has a bounded
    number of them: a keyword many lists share multiplies its matches, and only inside a task.
    """
    each = lists.select("list", "questions", F.size("words").cast("bigint").alias("total"), F.explode("words").alias("keyword"))
    counted = materialize(each.groupBy("list", "keyword").agg(F.count(F.lit(1)).alias("times"), F.max("total").alias("total"), F.max("questions").alias("questions")), "keywords")
    lowered = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    t = tables.select("table_id", F.lower("name").alias("name"), F.lower(F.coalesce("comment", F.lit(""))).alias("comment")).filter(F.col("table_id").isNotNull())
    f = fields.select("table_id", F.lower("field_name").alias("field_name"), lowered(F.col("comment")).alias("comment")).filter(F.col("table_id").isNotNull())
    words = counted.select("keyword").distinct()
    matches = materialize(_keyword_matches(t, f, words), "keyword-matches")
    askers = counted.groupBy("keyword").agg(F.count(F.lit(1)).alias("askers"), F.sum("questions").alias("questions"))
    met = matches.groupBy("keyword").agg(F.count(F.lit(1)).alias("met")).join(askers, "keyword")
    pairs, with_questions = (n or 0 for n in met.agg(F.sum(F.col("met") * F.col("askers")), F.sum(F.col("met") * F.col("questions"))).first())
    tasks = max(tables.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS_PER_TASK))

    flags = matches.repartition(tasks, "table_id").groupBy("keyword", "table_id").agg(F.bit_or("bit").alias("bits"))
    has = lambda name: F.col("bits").bitwiseAND(_KINDS[name]) != 0
    base = (
        F.when(has("name"), 1.0)
        .when(has("comment"), 0.9)
        .when(has("in_comment"), 0.7)
        .when(has("note"), 0.5)
        .when(has("in_note"), 0.4)
        .when(has("field"), 0.3)
        .otherwise(0.0)
    )
    sizes = t.select("table_id", F.size(_parts(F.col("name"))).alias("parts")).repartition(tasks, "table_id")
    scored = flags.select(
        "keyword", "table_id", has("name").alias("name"), has("comment").alias("comment"), has("part").alias("part"), base.alias("base")
    ).join(sizes, "table_id")
    per_pair = scored.join(counted.drop("questions"), "keyword").groupBy("list", "table_id").agg(
        F.bool_or("name").alias("named"),
        F.bool_or(F.col("comment") & ~F.col("name")).alias("commented"),
        F.max("base").alias("best"),
        F.count(F.lit(1)).alias("scored"),
        F.coalesce(F.sum(F.when(F.col("part"), F.col("times"))), F.lit(0)).alias("hit_parts"),
        F.max("parts").alias("parts"),
        F.max("total").alias("total"),
    )
    name_score = F.when(F.col("hit_parts") > 0, F.bround(F.lit(0.25) + F.lit(0.25) * F.col("hit_parts") / F.col("parts"), 2)).otherwise(0.0)
    mixed = F.greatest("best", name_score) * F.col("scored") / F.col("total")
    score = F.when(F.col("named"), 1.0).when(F.col("commented"), 0.9).otherwise(F.bround(mixed, 2))
    return per_pair.select("list", "table_id", score.alias("score")), with_questions


def best_tables(tables: DataFrame, fields: DataFrame, keywords: DataFrame, k: int = BEST_TABLES) -> DataFrame:
    """The k best tables of each question by keyword_scores, ties to the smaller table_id.

    Questions with the same keywords share one ranking: lists are scored and cut to k tables first, and only
    what is left of them meets the questions, so the result holds at most k rows for each question.
    """
    listed, lists = _keyword_lists(keywords)
    scored, _ = _scores(tables, fields, lists)
    order = Window.partitionBy("list").orderBy(F.desc("score"), "table_id")
    best = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return listed.join(best, "list").drop("list")


def _within(comments: DataFrame, words: DataFrame) -> DataFrame:
    """(comment, keyword) where the comment text contains the keyword."""
    held = comments.select(F.col("comment"), F.col("comment").alias("__text"))
    return contains_pairs(held, "comment", "__text", words, "keyword").withColumnRenamed("phrase", "keyword")


def take_within(items: Column, max_items: int, max_bytes: int, start: int = 2) -> Column:
    """First items that fit a count and byte budget; one too large is skipped, later ones may fit.

    `items` are structs with a `bytes` field, already in order.
    """
    empty = F.struct(F.lit(start).cast("bigint").alias("used"), F.filter(items, lambda _: F.lit(False)).alias("taken"))

    def add(state: Column, item: Column) -> Column:
        fits = (state["used"] + item["bytes"] + 1 <= max_bytes) & (F.size(state["taken"]) < max_items)
        return F.struct(
            (state["used"] + F.when(fits, item["bytes"] + 1).otherwise(0)).alias("used"),
            F.when(fits, F.concat(state["taken"], F.array(item))).otherwise(state["taken"]).alias("taken"),
        )

    return F.aggregate(items, empty, add, lambda s: s["taken"])


def _first_hits(pairs: DataFrame, max_items: int, max_bytes: int, hint_id: str) -> DataFrame:
    """Budgeted hints per question in id order; a question holds only the hints its own text matched."""
    gathered = pairs.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct(hint_id, "bytes"))).alias("items"))
    taken = gathered.select("question_id", F.posexplode(take_within(F.col("items"), max_items, max_bytes)).alias("at", "hint"))
    return taken.select("question_id", (F.col("at") + 1).alias("rank"), F.col(f"hint.{hint_id}").alias(hint_id))


MAX_HINTS, MAX_EXAMPLES, MAX_HINT_BYTES = 8, 4, 4096


def match_vocabulary(questions: DataFrame, terms: DataFrame) -> DataFrame:
    """Terms whose word or synonym appears in a question, first eight that fit 4 KiB, in term order.

    `questions`: question_id, datasource_id, text; `terms`: term_id, word, description, other_words,
    enabled, datasource_ids (empty for all).
    """
    asked = questions.select("question_id", "datasource_id", F.lower("text").alias("__text"))
    usable = terms.filter("enabled")
    words = usable.select(
        "term_id",
        F.explode(F.concat(F.array("word"), F.coalesce("other_words", F.array().cast("array<string>")))).alias("w"),
    ).select("term_id", F.lower("w").alias("phrase"))
    found = contains_pairs(asked, "question_id", "__text", words, "phrase")
    hint = F.struct(F.col("word"), F.col("description"), F.coalesce("other_words", F.array().cast("array<string>")).alias("other_words"))
    sized = usable.select("term_id", "datasource_ids", F.octet_length(F.to_json(hint)).cast("bigint").alias("bytes"))
    pairs = (
        found.join(words, "phrase")
        .select("question_id", "term_id")
        .distinct()
        .join(sized, "term_id")
        .join(asked.select("question_id", "datasource_id"), "question_id")
        .filter((F.size("datasource_ids") <= 0) | F.array_contains("datasource_ids", F.col("datasource_id")))
    )
    return _first_hits(pairs, MAX_HINTS, MAX_HINT_BYTES, "term_id")


def expand_keywords(keywords: DataFrame, terms: DataFrame, limit: int = 10) -> DataFrame:
    """Keywords widened by the terms they name, first ten words, order kept, case ignored.

    `keywords`: question_id, keywords (comma list); `terms`: term_id, word, other_words, enabled.
    """
    each = keywords.select(
        "question_id", F.posexplode(F.split("keywords", ",")).alias("at", "raw")
    ).select("question_id", "at", F.trim("raw").alias("word"))
    usable = terms.filter("enabled").select(
        "term_id", F.concat(F.array("word"), F.coalesce("other_words", F.array().cast("array<string>"))).alias("names")
    )
    keys = usable.select("term_id", F.explode("names").alias("n")).select("term_id", F.lower(F.trim("n")).alias("key")).distinct()
    widened = (
        each.withColumn("key", F.lower("word"))
        .join(keys, "key")
        .join(usable, "term_id")
        .select("question_id", F.lit(1).alias("wave"), "at", "term_id", F.posexplode("names").alias("name_at", "word"))
        .withColumn("word", F.trim("word"))
    )
    own = each.select(
        "question_id", F.lit(0).alias("wave"), "at", F.lit(0).cast("bigint").alias("term_id"), F.lit(0).alias("name_at"), "word"
    )
    place = F.struct("wave", "at", "term_id", "name_at")
    unique = (
        own.unionByName(widened)
        .filter(F.col("word") != "")
        .groupBy("question_id", F.lower("word").alias("key"))
        .agg(F.min(F.struct(place.alias("place"), "word")).alias("first"))
    )
    ordered = Window.partitionBy("question_id").orderBy("first.place")
    kept = unique.withColumn("rank", F.row_number().over(ordered)).filter(F.col("rank") <= limit)
    listed = kept.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "first.word"))).alias("w"))
    return listed.select("question_id", F.array_join(F.transform("w", lambda x: x["word"]), ",").alias("expanded"))


_QUOTED = r'"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[(?:[^\]]|\]\])*\]'


def quoted_spans(text: Column) -> Column:
    """Quoted identifiers of a text as (begin, end, name); 1-based begin, end exclusive."""
    pieces = F.regexp_extract_all(text, F.lit(_QUOTED), F.lit(0))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<begin:int,end:int,name:string>>").alias("spans"))

    def add(state: Column, piece: Column) -> Column:
        begin = F.call_function("locate", piece, text, state["at"])
        end = (begin + F.length(piece)).cast("int")
        inner = F.substr(piece, F.lit(2), F.length(piece) - 2)
        closing = F.right(piece, F.lit(1))
        name = F.replace(inner, F.concat(closing, closing), closing)
        span = F.struct(begin.cast("int").alias("begin"), end.alias("end"), name.alias("name"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.aggregate(pieces, start, add, lambda s: s["spans"])


_WORD = "^[A-Za-z0-9_]$"


def name_spans(text: Column, name: Column, quoted: Column) -> Column:
    """Places where a name stands as a whole identifier, or alone inside quotes.

    Each place is searched for behind the start of the one before, so overlapping ones count; then the characters on both
    sides are looked at. Nothing is compiled for a name.
    """
    size = F.length(name)
    place = lambda at: F.call_function("locate", name, text, at)
    # Cut into pieces at the name, a text has one more piece than places that do not overlap; a name that overlaps itself, such
    # as 'aa', can have as many places as characters.
    apart = (F.length(text) - F.length(F.replace(text, name, F.lit("")))) / size
    overlaps = F.exists(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda n: (size > 1) & (F.left(name, n) == F.right(name, n)))
    most = F.when(overlaps, F.length(text)).otherwise(apart).cast("int")
    start = F.struct(place(F.lit(1)).alias("at"), F.array().cast("array<int>").alias("starts"))

    def add(s: Column, _: Column) -> Column:
        found = F.when(s["at"] > 0, F.concat(s["starts"], F.array(s["at"]))).otherwise(s["starts"])
        return F.struct(F.when(s["at"] > 0, place(s["at"] + 1)).otherwise(0).alias("at"), found.alias("starts"))

    starts = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), start, add, lambda s: s["starts"])
    word_first, word_last = F.left(name, F.lit(1)).rlike(_WORD), F.right(name, F.lit(1)).rlike(_WORD)
    before = lambda i: F.when(i > 1, F.substring(text, i - 1, F.lit(1))).otherwise("")
    free = lambda i: ~(word_first & before(i).rlike(_WORD)) & ~(word_last & F.substring(text, i + size, F.lit(1)).rlike(_WORD))
    outside = F.filter(starts, lambda i: free(i) & ~F.exists(quoted, lambda q: (i < q["end"]) & (q["begin"] < i + size)))
    spans = F.transform(outside, lambda i: F.struct(i.alias("begin"), (i + size).alias("end")))
    exact = F.transform(F.filter(quoted, lambda q: q["name"] == name), lambda q: F.struct(q["begin"].alias("begin"), q["end"].alias("end")))
    return F.concat(spans, exact)


def find_mentions(questions: DataFrame, names: DataFrame, quotes: bool = True) -> DataFrame:
    """Names a question mentions explicitly; where spans overlap, the longest earliest one wins.

    `questions`: question_id, text; `names`: name. Only (question, name) pairs found by the
    phrase search are examined for places.
    """
    asked = questions.select("question_id", F.lower("text").alias("__text"))
    spans = quoted_spans(F.col("__text")) if quotes else F.array().cast("array<struct<begin:int,end:int,name:string>>")
    wanted = names.select(F.lower(F.trim("name")).alias("name")).filter(F.col("name") != "").distinct()
    # A doubled quote inside a quoted name hides it from a plain search, so such names are read from the quotes.
    found = contains_pairs(asked, "question_id", "__text", wanted, "name").withColumnRenamed("phrase", "name")
    if quotes:
        from_quotes = asked.select("question_id", F.explode(spans).alias("q")).select("question_id", F.col("q.name").alias("name"))
        found = found.unionByName(from_quotes.join(wanted, "name", "left_semi").select("question_id", "name")).distinct()
    placed = (
        found.join(asked.withColumn("__quoted", spans), "question_id")
        .select("question_id", "name", F.explode(name_spans(F.col("__text"), F.col("name"), F.col("__quoted"))).alias("s"))
        .select("question_id", "name", "s.begin", "s.end")
    )
    before = Window.partitionBy("question_id").orderBy("begin", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    furthest = F.coalesce(F.max("end").over(before), F.lit(-1))
    return placed.withColumn("__won", F.col("end") > furthest).filter("__won").select("question_id", "name").distinct()


def mentioned_tables(questions: DataFrame, tables: DataFrame) -> DataFrame:
    """(question_id, table_key) of the tables a question mentions by name or by their whole comment.

    `tables`: table_key, name, comment. Names and comments are matched apart, each with the longest earliest
    mention winning; only names may stand in quotes.
    """
    found = []
    for column, quotes in (("name", True), ("comment", False)):
        own = tables.select("table_key", F.lower(F.trim(column)).alias("name"))
        found.append(find_mentions(questions, own, quotes).join(own, "name").select("question_id", "table_key"))
    return found[0].unionByName(found[1]).distinct()


def _leading(hits: DataFrame, key: str) -> DataFrame:
    """Of a key's distinct hits those that can be among its first MAX_EXAMPLES: of one size, the first so many by id.

    A later one never can: each of them is given, or left out for want of room or places, of which there is never more later.
    """
    order = Window.partitionBy(key, "bytes").orderBy("example_id")
    # Two bytes enclose the list and one follows each item (see take_within).
    able = hits.select(key, "example_id", "bytes").filter(F.col("bytes") + 3 <= MAX_HINT_BYTES).distinct()
    return able.withColumn("__at", F.row_number().over(order)).filter(F.col("__at") <= MAX_EXAMPLES).drop("__at")


def match_examples(questions: DataFrame, examples: DataFrame) -> DataFrame:
    """Stored examples whose question contains, or is contained in, the asked one; the first four that fit.

    `questions`: question_id, text; `examples`: example_id, question, description, enabled. Texts are searched once, however
    many questions or examples share them, and stand for themselves by a digest. A task hands on only the examples that can be
    among a text's first four (see first_items), so their number does not grow with the pairs of texts.
    """
    digest = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 32))
    asked = questions.select("question_id", F.lower(F.trim("text")).alias("__text")).filter(F.col("__text") != "")
    known = examples.filter("enabled").select(
        "example_id",
        F.lower(F.trim("question")).alias("__sample"),
        F.octet_length(F.to_json(F.struct("question", "description"))).cast("bigint").alias("bytes"),
    ).filter(F.col("__sample") != "")
    able = lambda items: first_items(F.sort_array(items), MAX_EXAMPLES)
    samples = materialize(
        _leading(known, "__sample")
        .groupBy(F.col("__sample").alias("text"))
        .agg(able(F.collect_list(F.struct(F.col("example_id").alias("id"), "bytes"))).alias("items")),
        "examples",
    )
    texts = materialize(asked.select(F.col("__text").alias("text")).distinct().withColumn("key", digest("text")), "questions")
    forward = first_within(texts, samples, MAX_EXAMPLES).withColumn("forward", F.lit(True))
    backward = first_within(samples, texts, MAX_EXAMPLES).withColumn("forward", F.lit(False))
    # The search in questions goes by their ids, so one without an id has only the hits of the search in examples.
    gathered = forward.unionByName(backward).groupBy("key").agg(
        F.flatten(F.collect_list("items")).alias("all"), F.flatten(F.collect_list(F.when(~F.col("forward"), F.col("items")))).alias("unnamed")
    )
    hits = materialize(gathered.select("key", able(F.col("all")).alias("all"), able(F.col("unnamed")).alias("unnamed")), "example-hits")
    keyed = asked.select("question_id", digest("__text").alias("key"))
    mine = F.when(F.col("question_id").isNull(), F.col("unnamed")).otherwise(F.col("all"))
    own = keyed.join(hits, "key").groupBy("question_id").agg(F.array_distinct(F.flatten(F.collect_list(mine))).alias("items"))
    pairs = own.select("question_id", F.explode("items").alias("x")).select("question_id", F.col("x.id").alias("example_id"), "x.bytes")
    return _first_hits(pairs, MAX_EXAMPLES, MAX_HINT_BYTES, "example_id")


def text_fingerprint(model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(model), F.unhex(F.lit("00")).cast("string"), text), 256)


def changed_texts(texts: DataFrame, index: DataFrame, model: str, keys: Sequence[str], text: str = "schema_text") -> DataFrame:
    """Texts whose (model, text) fingerprint is not in the vector index yet."""
    printed = texts.withColumn("fingerprint", text_fingerprint(model, F.col(text)))
    return printed.join(index.select(*keys, "fingerprint"), [*keys, "fingerprint"], "left_anti")
