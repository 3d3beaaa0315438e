"""millrace: document, catalogue, retrieval and telemetry workloads as Spark dataflows."""
