"""Writing small test pictures; reading is left to Spark's image source."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Colour types of the file format by number of channels (fixed values).
COLOUR_TYPES = {1: 0, 3: 2, 4: 6}


def encode_png(pixels: np.ndarray) -> bytes:
    """(height, width) or (height, width, channels) uint8 -> an unfiltered PNG file."""
    pixels = np.atleast_3d(pixels)
    height, width, channels = pixels.shape
    lines = np.zeros((height, 1 + width * channels), np.uint8)
    lines[:, 1:] = pixels.reshape(height, -1)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, COLOUR_TYPES[channels], 0, 0, 0))]
    parts += [(b"IDAT", zlib.compress(lines.tobytes())), (b"IEND", b"")]
    chunks = [struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data)) for kind, data in parts]
    return b"\x89PNG\r\n\x1a\n" + b"".join(chunks)
