"""Run-record analytics on Spark: typed telemetry, histories, lineage, transport and views as DataFrame operators."""
