"""Concourse: a Spark-native airport-lounge and boarding-pass data product.

Pages become a nested airport/lounge catalog, OCR words and ticket text become
validated boarding-pass records, and passes joined to the catalog become ranked
lounge recommendations. Every operator is a ``DataFrame -> DataFrame`` function
with explicit parameters; nothing reads the wall clock or collects to the driver.
"""

__version__ = "0.1.0"
