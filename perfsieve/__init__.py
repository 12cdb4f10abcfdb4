"""perfsieve: Spark jobs that turn raw performance alerts into bug-prediction features and metrics."""
