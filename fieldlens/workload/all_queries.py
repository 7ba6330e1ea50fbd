"""Importing this module registers every query."""

from fieldlens.workload import (  # noqa: F401
    catalogue_queries,
    chunked_queries,
    consensus_queries,
    finding_queries,
    form_queries,
    package_queries,
    preparation_queries,
    rule_queries,
    sequence_queries,
    source_queries,
    streaming_queries,
)
