"""Every query of the engine and its SQL counterpart, by name."""

from tesserae.plans import bindings, contrasts, disclosure, estimation, forecasts, grid, ingestion, policies, resampled, studies

QUERIES: dict = {**policies.QUERIES, **grid.QUERIES, **estimation.QUERIES, **ingestion.QUERIES, **studies.QUERIES, **contrasts.QUERIES, **disclosure.QUERIES, **bindings.QUERIES, **resampled.QUERIES, **forecasts.QUERIES}
ORACLES: dict = {**policies.ORACLES, **grid.ORACLES, **estimation.ORACLES, **ingestion.ORACLES, **studies.ORACLES, **contrasts.ORACLES, **disclosure.ORACLES, **bindings.ORACLES, **resampled.ORACLES, **forecasts.ORACLES}
