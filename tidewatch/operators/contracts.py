"""Conformance of JSON records to record contracts, with quarantine."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatch.functions.plan import computed


def _is_integer(kind: Column) -> Column:
    return kind == "BIGINT"


def _conforms(kind: Column, number: Column, wanted: T.DataType) -> Column:
    if isinstance(wanted, T.StringType):
        return kind == "STRING"
    if isinstance(wanted, T.DoubleType):
        return _is_integer(kind) | kind.startswith("DECIMAL") | (kind == "DOUBLE")
    if isinstance(wanted, T.IntegerType):
        return _is_integer(kind) & number.between(-2147483648, 2147483647)
    return _is_integer(kind)


def check(records: DataFrame, contract: T.StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """Records (value, ...) with ``violations``: (field, problem) of every field that is missing
    or of another type. Text that is no JSON record breaks the record as a whole."""
    parsed = computed(records, doc=F.try_parse_json("value"))

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("doc", path, "variant"))

    kinds = F.struct(*[kind(f"$.{f.name}").alias(f.name) for f in contract.fields])
    typed = computed(parsed, whole=F.schema_of_variant("doc"), kinds=kinds)
    found = []
    for field in contract.fields:
        seen = F.coalesce(F.col("kinds")[field.name], F.lit("VOID"))
        number = F.try_variant_get("doc", f"$.{field.name}", "bigint")
        problem = F.when(seen == "VOID", F.lit(None if field.name in optional else "missing")).when(
            ~_conforms(seen, number, field.dataType), "type")
        found.append(F.when(problem.isNotNull(), F.struct(
            F.lit(field.name).alias("field"), problem.alias("problem"))))
    malformed = F.array(F.struct(F.lit("*").alias("field"), F.lit("malformed").alias("problem")))
    is_record = F.coalesce(F.col("whole").startswith("OBJECT"), F.lit(False))
    return computed(
        typed, violations=F.when(is_record, F.array_compact(F.array(*found))).otherwise(malformed),
    ).drop("doc", "whole", "kinds")


def conforming(records: DataFrame, contract: T.StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """Conforming records, typed by the contract. Fields a record lacks are null, so records of
    an older version can be read with a newer contract."""
    good = check(records, contract, optional).filter(F.size("violations") == 0).drop("violations")
    return computed(good, r=F.from_json("value", contract)).select(
        *[c for c in records.columns if c != "value"], "r.*")


def quarantine(records: DataFrame, contract: T.StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """One row per violation."""
    return check(records, contract, optional).select(
        "*", F.inline("violations")).drop("violations")


def change_impact(records: DataFrame, contract: T.StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """How many of the records would fail a contract, per field and problem."""
    return quarantine(records, contract, optional).groupBy("field", "problem").agg(
        F.count(F.lit(1)).alias("records"))


def versions_per_subject(records: DataFrame) -> DataFrame:
    """Contract versions in use per subject: (subject, version) rows to counts."""
    per_version = records.groupBy("subject", "version").agg(F.count(F.lit(1)).alias("n"))
    return per_version.groupBy("subject").agg(
        F.count(F.lit(1)).alias("versions"), F.max("version").alias("latest_version"),
        F.sum("n").alias("records"))
