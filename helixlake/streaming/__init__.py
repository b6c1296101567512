"""Sequencing stages over streams of reads: the same functions as in batch, with stream-static joins."""

from .stages import filtered, reads_per_barcode, with_megamash

__all__ = ["filtered", "reads_per_barcode", "with_megamash"]
