"""Extraction attempts to one payload per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docledger.functions.payload import is_object
from docledger.functions.text import filled, strip
from docledger.rules import PROVIDER_ORDER

MESSAGES = {
    "invalid_json": "Model returned invalid JSON",
    "invalid_json_shape": "Model output must be a JSON object",
    "empty_response": "OCR returned no text",
    "missing_api_key": "No provider API key found for configured fallback chain",
}


def parse_payload(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``payload`` (variant) and ``parse_error`` for a column of model text."""
    parsed = df.withColumn("_parsed", F.try_parse_json(F.col(text)))
    shaped = parsed.withColumn("_object", is_object(F.col("_parsed")))
    error = F.when(F.col(text).isNull(), F.lit(None)).when(
        F.col("_parsed").isNull(), F.lit("invalid_json")
    ).when(~F.col("_object"), F.lit("invalid_json_shape"))
    return shaped.select(
        *df.columns,
        F.when(F.col("_object"), F.col("_parsed")).alias("payload"),
        error.alias("parse_error"),
    )


def with_parse_errors(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Add ``payload``; model text that is no JSON object becomes the row's error unless it has one already."""
    messages = F.create_map(*[F.lit(part) for pair in MESSAGES.items() for part in pair])
    message = F.try_element_at(messages, F.col("parse_error"))
    failed = F.col("error_code").isNotNull()
    return parse_payload(df, text).withColumns({
        "error_code": F.coalesce("error_code", "parse_error"),
        "error_message": F.when(failed, F.col("error_message")).otherwise(F.coalesce(message, F.col("error_message"))),
    }).drop("parse_error")


def _winners(attempts: DataFrame, order: list[str], keep: list[str]) -> DataFrame:
    """One row per document and prompt: ``output`` (the first configured provider's, or null) and ``errors`` (all of them, in order).

    Attempts are divided by document once; the windows here and in ``pair_prompts`` sort them once and never put texts into an
    aggregate.
    """
    has_output = F.col("raw_text").isNotNull() & F.col("error").isNull()
    rank = F.coalesce(*[
        F.when(F.col("provider") == name, F.lit(place)) for place, name in enumerate(order)
    ]) if order else F.lit(None).cast("int")
    ranked = attempts.withColumn("rank", F.when(has_output, rank))
    group = W.partitionBy("document_id", "prompt_kind")
    errors = [
        F.max(F.when(F.col("provider") == name, F.concat(F.lit(f"{name}: "), F.col("error")))).over(group)
        for name in order
    ]
    output = F.when(F.col("rank").isNotNull(), F.struct("rank", "provider", "raw_text", "ocr_text"))
    return (
        ranked.withColumn("errors", F.concat_ws("; ", *errors) if errors else F.lit(""))
        .withColumn("place", F.row_number().over(group.orderBy(F.col("rank").asc_nulls_last())))
        .where("place = 1")
        .select(*keep, output.alias("output"), "errors")
    )


def _failed(order: list[str], output: Column, listed: Column) -> tuple[Column, Column]:
    if not order:
        return F.lit("missing_api_key"), F.lit(MESSAGES["missing_api_key"])
    code = F.when(output.isNull(), F.lit("all_providers_failed"))
    message = F.when(output.isNull(), F.concat(F.lit("All configured providers failed: "), listed))
    return code, message


def resolve_provider(attempts: DataFrame, order: list[str] = PROVIDER_ORDER) -> DataFrame:
    """Per document and prompt: the first configured provider with output, else the errors.

    ``attempts``: document_id, prompt_kind, provider, raw_text, ocr_text, error.
    """
    found = _winners(attempts, order, ["document_id", "prompt_kind"])
    code, message = _failed(order, F.col("output"), F.col("errors"))
    return found.select(
        "document_id",
        "prompt_kind",
        F.col("output.provider").alias("provider"),
        F.col("output.raw_text").alias("raw_text"),
        F.col("output.ocr_text").alias("ocr_text"),
        code.alias("error_code"),
        message.alias("error_message"),
    )


def pick_corrective(pairs: DataFrame, order: list[str] = PROVIDER_ORDER) -> DataFrame:
    """Payload per document from its first and corrective outputs, one row per document.

    ``pairs``: document_id, and structs ``first`` and ``corrective`` with fields rank, provider,
    raw_text, ocr_text, plus ``first_errors`` and ``corrective_errors``. The corrective output
    counts only where the first one is no JSON object; its own error is then final.
    """
    fields = [name for name in pairs.columns if not name.startswith(("first", "corrective"))]
    checked = parse_payload(
        pairs.withColumn("_text", F.col("first.raw_text")), "_text"
    ).withColumnsRenamed({"payload": "_first_payload", "parse_error": "_first_error"})
    retried = parse_payload(
        checked.withColumn(
            "_retry_text", F.when(F.col("_first_error").isNotNull(), F.col("corrective.raw_text"))
        ),
        "_retry_text",
    )
    use_retry = F.col("_first_error").isNotNull()
    code_1, message_1 = _failed(order, F.col("first"), F.col("first_errors"))
    code_2, message_2 = _failed(order, F.col("corrective"), F.col("corrective_errors"))
    messages = F.create_map(*[F.lit(part) for pair in MESSAGES.items() for part in pair])
    code = F.when(use_retry, F.coalesce(code_2, F.col("parse_error"))).otherwise(code_1)
    message = F.when(
        use_retry, F.coalesce(message_2, F.try_element_at(messages, F.col("parse_error")))
    ).otherwise(message_1)
    return retried.select(
        *fields,
        F.when(use_retry, F.col("payload")).otherwise(F.col("_first_payload")).alias("payload"),
        F.when(use_retry, F.col("corrective.provider")).otherwise(F.col("first.provider")).alias("provider"),
        F.when(use_retry, F.col("corrective.ocr_text")).otherwise(F.col("first.ocr_text")).alias("ocr_text"),
        F.when(use_retry, F.lit("corrective")).otherwise(F.lit("first")).alias("prompt_kind"),
        code.alias("error_code"),
        message.alias("error_message"),
    )


def pair_prompts(attempts: DataFrame, order: list[str] = PROVIDER_ORDER) -> DataFrame:
    """Both prompts' outcomes of each document side by side, one row per document; attempts of other prompts are ignored."""
    dealt = attempts.where(F.col("prompt_kind").isin("first", "corrective")).repartition("document_id")
    found = _winners(dealt, order, ["document_id", "prompt_kind"])
    # "corrective" sorts before "first": the last row of a document sees the other one behind it.
    document = W.partitionBy("document_id").orderBy("prompt_kind")
    none = F.lit(None).cast(found.schema["output"].dataType)
    sided = found.withColumns({
        "before": F.lag("output").over(document),
        "errors_before": F.lag("errors").over(document),
        "following": F.lead("prompt_kind").over(document),
    }).where(F.col("following").isNull())
    last = F.col("prompt_kind") == "first"
    return sided.select(
        "document_id",
        F.when(last, F.col("output")).otherwise(none).alias("first"),
        F.when(last, F.col("errors")).otherwise(F.lit("")).alias("first_errors"),
        F.when(last, F.col("before")).otherwise(F.col("output")).alias("corrective"),
        F.coalesce(F.when(last, F.col("errors_before")).otherwise(F.col("errors")), F.lit("")).alias("corrective_errors"),
    )


def resolve_payload(
    attempts: DataFrame, order: list[str] = PROVIDER_ORDER, requested: str = "auto"
) -> DataFrame:
    """Attempts to one payload (or error) per document, with provider and OCR text stamped."""
    return stamp_provenance(pick_corrective(pair_prompts(attempts, order), order), requested)


def assemble_ocr(pages: DataFrame) -> DataFrame:
    """Pages (document_id, page_no, markdown) to one text per document; blank pages are left out.

    A document without text gets the error ``empty_response``. The text is one cell of the result,
    so a document's pages have to meet in one task.
    """
    used = F.when(strip(F.col("markdown")) != "", F.struct("page_no", "markdown"))
    ordered = F.array_sort(F.collect_list(used))
    text = F.array_join(F.transform(ordered, lambda page: page["markdown"]), "\n\n")
    return (
        pages.groupBy("document_id")
        .agg(text.alias("_text"))
        .select(
            "document_id",
            filled(F.col("_text")).alias("ocr_text"),
            F.when(F.col("_text") == "", F.lit("empty_response")).alias("error_code"),
        )
    )


def stamp_provenance(df: DataFrame, requested: str = "auto") -> DataFrame:
    """Provider in lower case, else the requested one; OCR text only where it is non-blank."""
    return df.withColumns({
        "provider": F.lower(F.coalesce(filled(strip(F.col("provider"))), strip(F.lit(requested)))),
        "ocr_text": F.when(strip(F.col("ocr_text")) != "", F.col("ocr_text")),
    })


def content_hash(df: DataFrame, content: str = "content") -> DataFrame:
    """SHA-256 of a document's bytes as hexadecimal text."""
    return df.withColumn("file_hash", F.sha2(F.col(content), 256))
