"""trainset: Spark jobs that turn raw tables and files into model training data."""

__version__ = "0.1.0"
