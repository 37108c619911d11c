"""Column expressions over JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def schema_arg_keys(input_schema: Column) -> Column:
    """Argument names of an input schema: keys of its properties, else its own keys."""
    return F.json_object_keys(F.coalesce(F.get_json_object(input_schema, "$.properties"), input_schema))


def strict_json(text: Column) -> Column:
    """Variant of a JSON document, null for anything else.

    The built-in parser stops after the first value and ignores what follows. Inside an array and inside an
    object, leftovers break at least one of the two, so only text that is exactly one value passes both.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(in_array.isNotNull(), F.try_variant_get(in_object, "$.v", "variant"))


def parse_json_or_default(text: Column, data_type: T.DataType | str, default: Column) -> Column:
    """Typed JSON value; null, empty or broken text gives the default."""
    ddl = data_type if isinstance(data_type, str) else data_type.simpleString()
    return F.coalesce(F.try_variant_get(strict_json(text), "$", ddl), default)
