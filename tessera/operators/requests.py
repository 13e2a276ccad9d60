"""Request parsing and validation as column expressions: the first failing rule decides status and message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMBED = (
    "model string, texts array<string>, inputs array<struct<content:array<struct<type:string,text:string>>>>, images array<string>, input_type string, "
    "embedding_types array<string>, output_dimension int, max_tokens int, truncate string, priority int"
)
RERANK = (
    "model string, query string, documents array<string>, top_n int, return_documents boolean, rank_fields array<string>, max_chunks_per_doc int, max_tokens_per_doc int, priority int"
)
OPENAI = "model string, input array<string>, encoding_format string, dimensions int, user string"
#: Fixed values of the request format, in the order in which messages list them.
INPUT_TYPES = ("search_document", "search_query", "classification", "clustering")

Rule = tuple[Column, int, Column]


def _rules(rules: list[Rule]) -> Column:
    """A struct of status and message, status 200 where no rule fails."""
    out = F.struct(F.lit(200).alias("status"), F.lit(None).cast("string").alias("message"))
    for failed, status, message in reversed(rules):
        out = F.when(failed, F.struct(F.lit(status).alias("status"), message.alias("message"))).otherwise(out)
    return out


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _first(array: Column, bad) -> Column:
    """Index, from 0, of the first element that is bad; null if there is none."""
    return F.array_min(F.filter(F.transform(array, lambda x, i: F.when(bad(x), i)), lambda i: i.isNotNull()))


def _blank(s: Column) -> Column:
    return s.isNull() | (F.trim(s) == "")


def route(requests: DataFrame, models: DataFrame, task: str) -> DataFrame:
    """Adds model facts by name: `name` (null if no model of the task has it), dimension, max_input_tokens, and whether any model has the name.

    A request of version 1 without a model goes to the only model of the task, if there is only one. Models are a configuration's few rows.
    """
    own = models.where(F.col("task") == task).select(F.col("name"), "dimension", "max_input_tokens")
    sole = models.where(F.col("task") == task).agg(F.when(F.count("*") == 1, F.max("name")).alias("sole"))
    every = models.select(F.col("name").alias("any_name")).distinct()
    named = requests.join(F.broadcast(sole)).withColumn("requested", F.when(~_blank(F.col("model")), F.col("model")).when(F.col("version") == 1, F.col("sole"))).drop("sole")
    return named.join(F.broadcast(own), named.requested == own["name"], "left").join(F.broadcast(every), F.col("requested") == F.col("any_name"), "left").withColumn("exists", F.col("any_name").isNotNull()).drop("any_name")


def _model_rules(task: str) -> list[Rule]:
    m = F.col("requested")
    return [
        (m.isNull(), 400, F.lit("model is required")),
        (F.col("name").isNull() & F.col("exists"), 400, _text("model '", m, f"' does not support {task}")),
        (F.col("name").isNull(), 404, _text("model '", m, "' not found")),
    ]


def validate_embed() -> Column:
    """Of routed embedding requests; the rules are tried in this order."""
    texts, inputs = F.col("texts"), F.col("inputs")
    part = lambda x: F.get(x["content"], F.lit(0))
    single = _first(inputs, lambda x: x.isNull() | x["content"].isNull() | (F.size(x["content"]) != 1))
    other = _first(inputs, lambda x: part(x).isNull() | part(x)["type"].isNull() | (part(x)["type"] != "text"))
    empty = _first(inputs, lambda x: part(x)["text"].isNull())
    bad = F.least(single, other, empty)  # the first bad input, by its own first failing rule
    given = F.coalesce(inputs.isNotNull(), F.lit(False))
    gone = _first(texts, lambda x: x.isNull())
    types, kind, dim = F.col("embedding_types"), F.col("input_type"), F.col("output_dimension")
    odd = _first(types, lambda x: x.isNull() | (x != "float"))
    cut = F.upper("truncate")
    return _rules(
        [
            *_model_rules("embed"),
            (F.coalesce(F.size("images") > 0, F.lit(False)), 400, F.lit("image inputs are not supported")),
            (texts.isNotNull() & given, 400, F.lit("set either texts or inputs, not both")),
            (given & (F.col("version") == 1), 400, F.lit("inputs is a v2 field: use texts")),
            (given & bad.isNotNull() & (single == bad), 400, _text("inputs[", bad.cast("string"), "] must hold exactly one text content part")),
            (given & bad.isNotNull() & (other == bad), 400, _text("inputs[", bad.cast("string"), "]: only text content is supported")),
            (given & bad.isNotNull(), 400, _text("inputs[", bad.cast("string"), "] has no text")),
            (F.coalesce(F.size(F.when(given, inputs.cast("array<string>")).otherwise(texts)), F.lit(0)) < 1, 400, F.lit("texts must not be empty")),
            (~given & gone.isNotNull(), 400, _text("texts[", gone.cast("string"), "] is null")),
            (kind == "image", 400, F.lit("image inputs are not supported")),
            (kind.isNotNull() & ~kind.isin(*INPUT_TYPES), 400, _text("invalid input_type '", kind, f"', expected one of [{', '.join(INPUT_TYPES)}]")),
            (odd.isNotNull(), 400, _text("embedding type '", F.coalesce(F.get(types, odd), F.lit("null")), "' is not supported, only float")),
            (dim.isNotNull() & (dim != F.col("dimension")), 400, _text("output_dimension ", dim.cast("string"), " is not available: model '", F.col("requested"), "' produces ", F.col("dimension").cast("string"), " dimensions")),
            (F.col("max_tokens") < F.col("max_input_tokens"), 400, _text("max_tokens below the model limit (", F.col("max_input_tokens").cast("string"), ") is not supported")),
            (cut == "START", 400, F.lit("truncate START is not supported, use END or NONE")),
            (cut.isNotNull() & ~cut.isin("END", "NONE"), 400, _text("invalid truncate '", F.col("truncate"), "', expected NONE, START or END")),
        ]
    )


def refuse_truncation(api: str) -> Column:
    """After tokenizing: a message where `first_truncated` may not be."""
    at, limit = F.col("first_truncated"), F.col("max_input_tokens").cast("string")
    if api == "openai":
        return F.when(at >= 0, _text("input[", at.cast("string"), "] exceeds the maximum context length of ", limit, " tokens"))
    return F.when((at >= 0) & (F.upper("truncate") == "NONE"), _text("texts[", at.cast("string"), "] exceeds the model limit of ", limit, " tokens and truncate is NONE"))


def validate_rerank() -> Column:
    docs = F.col("documents")
    gone = _first(docs, lambda x: x.isNull())
    return _rules(
        [
            *_model_rules("rerank"),
            (F.col("query").isNull(), 400, F.lit("query is required")),
            (F.coalesce(F.size(docs), F.lit(0)) < 1, 400, F.lit("documents must not be empty")),
            (gone.isNotNull(), 400, _text("documents[", gone.cast("string"), "] has no text")),
            (F.size("rank_fields") > 0, 400, F.lit("rank_fields is not supported: pass the text to rank as a string or in a text field")),
            (F.col("max_tokens_per_doc") < F.col("max_input_tokens"), 400, _text("max_tokens_per_doc below the model limit (", F.col("max_input_tokens").cast("string"), ") is not supported")),
            (F.col("top_n") < 1, 400, F.lit("top_n must be at least 1")),
        ]
    )


def effective_top_n() -> Column:
    return F.least(F.coalesce("top_n", F.size("documents")), F.size("documents"))


def validate_openai() -> Column:
    """Adds the error code to status and message; the model must be named."""
    m, given, form, dim = F.col("requested"), F.col("input"), F.col("encoding_format"), F.col("dimensions")
    bad = _first(given, lambda x: x.isNull() | (x == ""))
    found = _rules(
        [
            (m.isNull(), 400, F.lit("model is required")),
            (F.col("name").isNull() & F.col("exists"), 400, _text("model '", m, "' does not support embeddings")),
            (F.col("name").isNull(), 404, _text("The model '", m, "' does not exist")),
            (F.coalesce(F.size(given), F.lit(0)) < 1, 400, F.lit("input must not be empty")),
            (bad.isNotNull(), 400, _text("input[", bad.cast("string"), "] must be a non-empty string")),
            (form.isNotNull() & ~form.isin("float", "base64"), 400, _text("encoding_format must be float or base64, got '", form, "'")),
            (dim.isNotNull() & (dim != F.col("dimension")), 400, _text("dimensions ", dim.cast("string"), " is not available: model '", m, "' produces ", F.col("dimension").cast("string"), " dimensions")),
        ]
    )
    return F.struct(found["status"].alias("status"), found["message"].alias("message"), F.when(found["status"] == 404, "model_not_found").alias("code"))


def parse(bodies: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """The body's fields, and `malformed` where it is no JSON object; unknown keys are ignored."""
    v = F.try_parse_json(body)
    malformed = v.isNull() | ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return bodies.withColumn("malformed", malformed).withColumn("r", F.from_json(body, schema)).select("*", "r.*").drop("r")


def document_texts(body: Column) -> Column:
    """The documents of a rerank body, each a string or an object with a text; null where it has none."""
    items = F.variant_get(F.try_parse_json(body), "$.documents", "array<variant>")
    kind = lambda v: F.schema_of_variant(v)
    return F.transform(items, lambda v: F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.try_variant_get(v, "$.text", "string")))


def input_texts(body: Column) -> tuple[Column, Column]:
    """The texts of an `input` that is a string or an array of strings, and a message for any other."""
    v = F.variant_get(F.try_parse_json(body), "$.input", "variant")
    kind = F.schema_of_variant(v)
    items = F.try_variant_get(v, "$", "array<variant>")
    kinds = F.transform(items, lambda x: F.schema_of_variant(x))
    odd = _first(kinds, lambda k: ~k.isin("STRING", "VOID"))
    first = F.get(kinds, odd)
    message = (
        F.when((kind == "STRING") | v.isNull(), None)
        .when(items.isNull(), "input must be a string or an array of strings")
        .when((first == "BIGINT") | first.startswith("ARRAY"), "token-id inputs are not supported, send text")
        .when(odd.isNotNull(), "input must be a string or an array of strings")
    )
    texts = F.when(kind == "STRING", F.array(F.try_variant_get(v, "$", "string"))).otherwise(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))
    return F.when(message.isNull(), texts), message.cast("string")


def authorized(requests: DataFrame, keys: DataFrame, header: str = "authorization", digest: str = "digest") -> DataFrame:
    """Requests whose bearer key has a known SHA-256."""
    from ..functions.scalars import bearer_digest

    return requests.join(keys, bearer_digest(F.col(header)) == F.col(digest), "left_semi")
