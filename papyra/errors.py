"""One exception class for each way an operation can fail."""

from __future__ import annotations


class PapyraError(Exception):
    """Base of all errors raised by the engine."""

    text = "{0}"

    def __init__(self, *detail: object) -> None:
        self.detail = detail
        super().__init__(self.text.format(*detail))


def _kind(name: str, text: str) -> type[PapyraError]:
    return type(name, (PapyraError,), {"text": text, "__module__": __name__})


InvalidFileFormat = _kind("InvalidFileFormat", "Invalid file format: {0}")
CorruptedRecord = _kind("CorruptedRecord", "Corrupted record at offset {0}: {1}")
IOFailure = _kind("IOFailure", "I/O error: {0}")
IdFieldMissing = _kind("IdFieldMissing", "Document is missing id field '{0}'")
PartitionKeyMissing = _kind("PartitionKeyMissing", "Document is missing partition key '{0}'")
DuplicateId = _kind("DuplicateId", "A document with id '{0}' already exists")
DocumentNotFound = _kind("DocumentNotFound", "No document with id '{0}'")
EncodingFailed = _kind("EncodingFailed", "Encoding failed: {0}")
DecodingFailed = _kind("DecodingFailed", "Decoding failed: {0}")
CollectionNotFound = _kind("CollectionNotFound", "Collection '{0}' not found")
CollectionTypeMismatch = _kind("CollectionTypeMismatch", "Collection '{0}' was opened with a different configuration")
CompressionFailed = _kind("CompressionFailed", "Compression failed")
DecompressionFailed = _kind("DecompressionFailed", "Decompression failed")
UnsupportedCompression = _kind("UnsupportedCompression", "Compression method '{0}' is not supported on this platform")
DecryptionFailed = _kind("DecryptionFailed", "Decryption failed")
EncryptionFailed = _kind("EncryptionFailed", "Encryption failed")
UnsupportedOperation = _kind("UnsupportedOperation", "Unsupported operation: {0}")
DatabaseClosed = _kind("DatabaseClosed", "Database has been closed")
