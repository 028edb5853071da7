"""Model catalogue: free text models, and the order in which models are tried."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from garimpo import rules
from garimpo.functions.text import blank_to_null
from garimpo.operators.dedupe import keep_first

CATALOG = (
    "id string, pricing struct<prompt:string,completion:string>, "
    "architecture struct<output_modalities:array<string>,modality:string>"
)


def read_catalog(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Catalogue documents ``{"data": [...]}`` as rows with their list position."""
    parsed = F.from_json(F.col(body), f"data array<struct<{_struct_ddl(CATALOG)}>>")
    return bodies.select(F.posexplode(parsed["data"]).alias("position", "model")).select(
        "position", "model.*"
    )


def _struct_ddl(columns: str) -> str:
    return columns.replace("id string", "id:string").replace("pricing struct", "pricing:struct").replace(
        "architecture struct", "architecture:struct")


def is_free(pricing: Column) -> Column:
    prompt, completion = pricing["prompt"].try_cast("double"), pricing["completion"].try_cast("double")
    return F.coalesce((prompt == 0) & (completion == 0), F.lit(False))


def writes_text_only(architecture: Column) -> Column:
    """Text is the sole output; unknown output counts as text."""
    outputs, modality = architecture["output_modalities"], blank_to_null(architecture["modality"])
    return (
        F.when(outputs.isNotNull(), outputs == F.array(F.lit("text")))
        .when(modality.isNotNull(), F.endswith(modality, F.lit("->text")))
        .otherwise(F.lit(True))
    )


def catalog_filter(catalog: DataFrame, limit: int = rules.MAX_FREE_MODELS) -> DataFrame:
    """The first ``limit`` free text models in catalogue order."""
    free = catalog.filter(
        blank_to_null(F.col("id")).isNotNull() & is_free(F.col("pricing"))
        & writes_text_only(F.col("architecture"))
    )
    return free.orderBy("position").limit(limit)


def ordered_union_distinct(first: Sequence[str], discovered: DataFrame, pinned: str | None = None,
                           id_column: str = "id", position: str = "position") -> DataFrame:
    """Configured models, then discovered ones not among them; a pinned model stands alone.

    Returns ``model_id`` with its sort key ``(list_no, place)``.
    """
    spark = discovered.sparkSession
    names = [pinned.strip()] if pinned and pinned.strip() else list(first)
    configured = spark.createDataFrame(
        [(0, i, n) for i, n in enumerate(names)], "list_no int, place long, model_id string"
    )
    if pinned and pinned.strip():
        return configured.select("model_id", "list_no", "place")
    found = discovered.select(
        F.lit(1).alias("list_no"), F.col(position).cast("long").alias("place"),
        F.col(id_column).alias("model_id"),
    )
    first_seen = keep_first(
        configured.union(found), {"key": F.col("model_id")}, F.struct("list_no", "place")
    )
    return first_seen.select("model_id", "list_no", "place")
