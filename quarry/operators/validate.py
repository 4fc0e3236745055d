"""Type coercion and validation as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.arrow import explode_rows
from quarry.operators.responses import parse
from quarry.schema import ResolverError, violations

#: The shapes of coercible texts. Character classes follow Unicode, anchors the whole text.
PERCENT = r"(?U)^(\d*\.?\d+)%\z"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
PHONE = r"^\(?([0-9]{3})\)?[-. ]?([0-9]{3})[-. ]?([0-9]{4})\z"
URL = r"(?U)^https?://[^\s/$.?#].[^\s]*\z"
DATE = r"(?U)^\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\w+ \d{1,2}, \d{4}\z"
CURRENCY = r"(?U)^\$+([\d,]+(?:\.\d{1,2})?)\s*(?:million|M|billion|B|thousand|K)?\z|^([\d,]+(?:\.\d{1,2})?)\s*(?:million|M|billion|B|thousand|K)\z"
INTEGER = r"(?U)^[+-]?\d+\z"
FLOAT = r"(?U)^[+-]?\d*\.?\d+([eE][+-]?\d+)?\z"
TRUE, FALSE = ("true", "yes", "y", "on", "enabled"), ("false", "no", "n", "off", "disabled")
NO_TYPE = "No applicable coercion found"

COERCED = "struct<target_type:string,success:boolean,long_value:bigint,double_value:double,bool_value:boolean,string_value:string,json_value:string,error_message:string>"


def _made(target: str, success: bool = True, **values: Column) -> Column:
    fields = {"target_type": F.lit(target), "success": F.lit(success), "long_value": None, "double_value": None, "bool_value": None, "string_value": None, "json_value": None, "error_message": None} | values
    return F.struct(*((v if v is not None else F.lit(None)).alias(k) for k, v in fields.items())).cast(COERCED)


def target_type(value: Column) -> Column:
    """The first type whose shape fits the trimmed value, else `string`."""
    v = F.regexp_replace(value, r"(?U)^\s+|\s+\z", "")
    return (
        F.when(v.rlike(PERCENT), "percentage").when(v.rlike(EMAIL), "email").when(v.rlike(PHONE), "phone").when(v.rlike(URL), "url").when(v.rlike(DATE), "date")
        .when(v.rlike(CURRENCY) & v.rlike("[0-9]"), "currency").when(v.rlike(INTEGER), "integer").when(v.rlike(FLOAT), "float").when(F.lower(v).isin(*TRUE, *FALSE), "boolean").otherwise("string")
    )


def coerce(value: Column) -> Column:
    """A value with its type, one expression: percentage, e-mail, phone, URL, date, currency, integer, float, boolean, in that
    order. An integer that does not fit 64 bits fails and ends the search; a value of no type fails as a string."""
    trimmed = F.regexp_replace(value, r"(?U)^\s+|\s+\z", "")
    # the value and its type are bound once, as every branch needs them
    return F.get(F.transform(F.array(F.struct(trimmed.alias("v"), target_type(trimmed).alias("t"))), lambda x: _coerced(x["v"], x["t"])), F.lit(0))


def _coerced(v: Column, t: Column) -> Column:
    low = F.lower(v)
    number = lambda c: c.try_cast("double")
    amount = number(F.replace(F.coalesce(F.nullif(F.regexp_extract(v, CURRENCY, 1), F.lit("")), F.regexp_extract(v, CURRENCY, 2)), F.lit(","), F.lit("")))
    times = F.when(low.contains("m"), 1e6).when(low.contains("b"), 1e9).when(low.contains("k") | low.contains("thousand"), 1e3).otherwise(1.0)
    area = F.regexp_extract(v, PHONE, 1)
    phone = F.concat(F.lit("("), area, F.lit(") "), F.regexp_extract(v, PHONE, 2), F.lit("-"), F.regexp_extract(v, PHONE, 3))
    as_json = lambda kind, c, **more: F.to_json(F.struct(*(x.alias(k) for k, x in more.items()), c.alias(kind), F.lit(kind).alias("type")))
    whole = v.try_cast("bigint")
    return (
        F.when(t == "percentage", _made("percentage", double_value=number(F.regexp_extract(v, PERCENT, 1)) / 100.0))
        .when(t == "email", _made("email", string_value=v, json_value=as_json("email", v)))
        .when(t == "phone", _made("phone", string_value=phone, json_value=as_json("phone", phone, area_code=area)))
        .when(t == "url", _made("url", string_value=v, json_value=as_json("url", v)))
        .when(t == "date", _made("date", string_value=v, json_value=as_json("date", v)))
        .when(t == "currency", _made("currency", double_value=amount * times))
        .when((t == "integer") & whole.isNotNull(), _made("integer", long_value=whole))
        .when(t == "integer", _made("integer", False, error_message=F.lit("Integer out of range")))
        .when(t == "float", _made("float", double_value=F.when(F.abs(v.try_cast("double")) < float("inf"), v.try_cast("double")).otherwise(0.0)))
        .when(t == "boolean", _made("boolean", bool_value=low.isin(*TRUE)))
        .otherwise(_made("string", False, error_message=F.lit(NO_TYPE)))
    )


def coerced_text(c: Column, original: Column) -> Column:
    """The coerced value as JSON text; the original string where coercion failed."""
    quoted = F.regexp_extract(F.to_json(F.struct(original.alias("v"))), r"(?s)^\{\"v\":(.*)\}\z", 1)
    return F.when(~c["success"], quoted).otherwise(F.coalesce(c["json_value"], c["long_value"].cast("string"), c["double_value"].cast("string"), c["bool_value"].cast("string"), quoted))


@dataclass(frozen=True)
class ValidationConfig:
    """schema: check fields and texts at all; raw_folder: where the engine keeps raw answers (None: nowhere); quality: least score of
    a value that the engine returns."""

    require_all_fields: bool = False
    coerce_types: bool = True
    long_text: int = 1000
    schema: bool = True
    raw_folder: str | None = None
    quality: float = 0.0


def validate(rows: DataFrame, expected: list[str], keys: list[str], config: ValidationConfig = ValidationConfig()) -> DataFrame:
    """One row for each response (keys): is_valid, errors, warnings, corrected_data, counts of coerced and failed values.

    rows: keys, ordinal, extraction_class, extraction_text. One shuffle by keys, aggregated before it. Later values of a class
    overwrite earlier ones in corrected_data, which is null if no value was coerced.
    """
    c = coerce(F.col("extraction_text"))
    x = rows.withColumn("_c", c if config.coerce_types else F.lit(None).cast(COERCED))
    path = F.concat(F.lit("extractions["), F.col("ordinal"), F.lit("]"))
    warn = lambda text: F.struct(text.alias("message"), path.alias("field_path"))
    x = x.withColumn("_w", F.when(F.trim(F.regexp_replace("extraction_text", r"(?U)\s+", " ")) == "", warn(F.concat(F.lit("no text under '"), "extraction_class", F.lit("'")))).when(F.length("extraction_text") > config.long_text, warn(F.concat(F.lit("a text of "), F.length("extraction_text"), F.lit(" characters under '"), "extraction_class", F.lit("'")))))
    ok = F.coalesce(F.col("_c.success"), F.lit(False))
    last = F.struct("extraction_class", "ordinal", F.coalesce(coerced_text(F.col("_c"), F.col("extraction_text")), F.lit("null")).alias("v"))
    g = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.collect_set("extraction_class").alias("_classes"), F.array_sort(F.collect_list(F.struct("ordinal", "_w"))).alias("_warned"),
        F.array_sort(F.collect_list(last)).alias("_values"), F.count_if(ok).alias("successful"), F.count_if(~ok & F.col("_c").isNotNull()).alias("failed"),
    )
    missing = F.array_except(F.array(*map(F.lit, expected)).cast("array<string>"), "_classes")
    errors = F.transform(missing, lambda m: F.struct(F.concat(F.lit("nothing found for '"), m, F.lit("'")).alias("message"), m.alias("field_path")))
    few = F.when(F.col("n") < len(expected) // 2, F.array(F.struct(F.concat(F.lit("only "), "n", F.lit(" values for "), F.lit(len(expected)), F.lit(" fields")).alias("message"), F.lit("extractions").alias("field_path"))))
    none = F.array().cast("array<struct<message:string,field_path:string>>")
    warnings = F.concat(F.filter(F.transform("_warned", lambda w: w["_w"]), lambda w: w.isNotNull()).cast("array<struct<message:string,field_path:string>>"), F.coalesce(few.cast("array<struct<message:string,field_path:string>>"), none))
    # by class, then place: a class's last value is followed by another class
    final = F.filter("_values", lambda v, i: ~F.get("_values", i + 1)["extraction_class"].eqNullSafe(v["extraction_class"]))
    pairs = F.transform(final, lambda p: F.concat(F.regexp_extract(F.to_json(F.struct(p["extraction_class"].alias("v"))), r"(?s)^\{\"v\":(.*)\}\z", 1), F.lit(":"), p["v"]))
    errors = errors.cast("array<struct<message:string,field_path:string>>") if config.require_all_fields and config.schema else none
    warnings = warnings if config.schema else none
    return g.select(
        *keys, (F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), warnings.alias("warnings"),
        F.when(F.col("successful") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).alias("corrected_data"),
        F.col("successful").cast("int").alias("successful"), F.col("failed").cast("int").alias("failed"),
    )


def check_answers(responses: DataFrame, schema: dict[str, Any], response_col: str = "response") -> DataFrame:
    """responses with `invalid`: where an answer is not as the schema has it, null if it is, or if there is no answer."""

    def make(response: str | None) -> list[tuple[str | None]]:
        if response is None:
            return [(None,)]
        try:
            return [("; ".join(violations(parse(response), schema)) or None,)]
        except ResolverError as e:
            return [(str(e),)]

    return explode_rows(responses, [response_col], make, "invalid string")
