"""Multi-channel, uniformly sampled time series with gaps, on Spark DataFrames."""

from tidegrid.api import Acquisition, LegacyReader, LegacyWriter, Metadata, Reader, Subject, Writer
from tidegrid.sources.bytesource import archive_session, extract_session

__all__ = ["Acquisition", "LegacyReader", "LegacyWriter", "Metadata", "Reader", "Subject", "Writer", "archive_session", "extract_session"]
