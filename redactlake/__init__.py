"""redactlake: find, mask and restore personal data and secrets in Spark tables and streams."""

from redactlake.functions.scan import ScanOptions, findings_of, masked_text
from redactlake.operators.scans import anonymize, explode_findings, scan_texts

__all__ = [
    "ScanOptions",
    "anonymize",
    "explode_findings",
    "findings_of",
    "masked_text",
    "scan_texts",
]
