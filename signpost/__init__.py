"""Catalog retrieval, routing and learning as Spark jobs."""

from signpost.operators.catalog import (
    create_entries,
    delete_names,
    delete_provider,
    fill_embeddings,
    purge_source,
    replace_source,
    update_entries,
    upsert_catalog,
)
from signpost.operators.circuit import circuit_state_at, circuit_trace, reset_circuits, tripped_circuits
from signpost.operators.entries import normalize_entries
from signpost.operators.usage import apply_usage, fold_usage, merge_folds
from signpost.plans.auto import auto, dispatch
from signpost.plans.route import route
from signpost.sources.listings import ingest_bulk, ingest_listings
from signpost.sources.manifests import load_manifests, scan_manifests, triage_manifests
from signpost.sources.snapshot import read_catalog, write_catalog

__all__ = [
    "apply_usage",
    "auto",
    "circuit_state_at",
    "circuit_trace",
    "create_entries",
    "delete_names",
    "delete_provider",
    "dispatch",
    "fill_embeddings",
    "fold_usage",
    "ingest_bulk",
    "ingest_listings",
    "load_manifests",
    "merge_folds",
    "normalize_entries",
    "purge_source",
    "read_catalog",
    "replace_source",
    "reset_circuits",
    "route",
    "scan_manifests",
    "triage_manifests",
    "tripped_circuits",
    "update_entries",
    "upsert_catalog",
    "write_catalog",
]
