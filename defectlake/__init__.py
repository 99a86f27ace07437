"""defectlake: defect-report, heap-profile and taint analytics as Spark jobs."""

__version__ = "0.1.0"
