"""End-to-end plans composed from the operators: the data pipeline
(readings -> master -> joined), the event study and the models, plus the
query catalog used by the driver entry points."""
