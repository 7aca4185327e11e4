"""Foreign schemas as RecordSpecs: Hive tables, COBOL copybooks, XML samples and XSD."""

from .cobol import import_cobol, record_bytes
from .hive import import_hive
from .xml import import_xml

__all__ = ["import_cobol", "import_hive", "import_xml", "record_bytes"]
