"""What a scan may be told."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScanPolicy:
    """exhaustive keeps placeholders, code-asset paths and YAML keys of any name; limits are in bytes."""

    entropy_threshold: float = 4.5
    exhaustive: bool = False
    keywords: tuple[str, ...] = ()
    max_blob_bytes: int = 4 << 20
    max_line_bytes: int = 2000
    max_minified_bytes: int = 50_000
