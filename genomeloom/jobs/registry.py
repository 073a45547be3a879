"""Every registered query and, under the same name, its SQL for another engine."""

from __future__ import annotations

from genomeloom.jobs import catalog_jobs, curation_jobs, feature_jobs, group_jobs, sequence_jobs, workflow_jobs

MODULES = (feature_jobs, group_jobs, curation_jobs, catalog_jobs, sequence_jobs, workflow_jobs)
QUERIES = {name: job for m in MODULES for name, job in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
