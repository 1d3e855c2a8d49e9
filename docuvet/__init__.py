"""Bulk identity-document screening on Spark.

Tables of text lines, decoded barcodes, image metrics, face embeddings and camera
frames go in; tables of fields, validations, verdicts, risk, reasons and KPIs come out.
Every operator is ``DataFrame -> DataFrame`` or ``Column -> Column``.
"""
