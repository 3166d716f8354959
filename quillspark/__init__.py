"""quillspark: declarative PySpark operators for building, retrieving from and auditing text datasets."""

__version__ = "0.1.0"
