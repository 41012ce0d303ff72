"""Scan options: defaults, presets and the limits that inputs are held to."""

from __future__ import annotations

from dataclasses import dataclass, replace


#: Names that older options have for what has other names now, and the models that went with two of them.
DETECTORS = {"vision": "ml", "ml_light": "ml", "ml_heavy": "ml"}
DETECTOR_MODELS = {"ml_light": "fast", "ml_heavy": "accurate"}
ACCELERATIONS = {"avx2": "cpu", "neon": "cpu", "metal": "gpu", "cuda": "gpu", "open_cl": "portable"}
DEVICES = {"cuda": "gpu"}


@dataclass(frozen=True)
class ScanOptions:
    preview_size: int = 1280
    refine_size: int = 2048
    refine_candidates: int = 2
    thumb_size: int = 320
    max_seq_gap: int = 12
    max_time_gap_ms: int = 1250
    max_cluster_span_ms: int = 1800
    max_hash_gap: int = 30
    max_duplicate_distance: float = 0.20
    min_duplicate_confidence: float = 0.52
    keepers_per_cluster: int | None = None
    refine: bool = True
    near_tie: float = 0.035
    acceleration: str = "auto"
    detector: str = "auto"
    detector_model: str = "fast"
    detector_device: str = "auto"
    workers: int | None = None

    def normalized(self) -> ScanOptions:
        """Distances held to [0.01, 1], confidences to [0, 1], sizes to at least 1; detectors by the names they have now."""
        return replace(
            self,
            acceleration=ACCELERATIONS.get(self.acceleration, self.acceleration),
            detector=DETECTORS.get(self.detector, self.detector),
            detector_model=DETECTOR_MODELS.get(self.detector, self.detector_model),
            detector_device=DEVICES.get(self.detector_device, self.detector_device),
            max_duplicate_distance=min(max(self.max_duplicate_distance, 0.01), 1.0),
            min_duplicate_confidence=min(max(self.min_duplicate_confidence, 0.0), 1.0),
            preview_size=max(1, self.preview_size),
            refine_size=max(1, self.refine_size),
        )

    @property
    def refines(self) -> bool:
        return self.refine and self.refine_size > self.preview_size and self.refine_candidates > 0


def from_seconds(gap_s: float, span_s: float, **more) -> ScanOptions:
    """Options from command-line seconds, rounded to milliseconds."""
    return ScanOptions(max_time_gap_ms=int(gap_s * 1000 + 0.5), max_cluster_span_ms=int(span_s * 1000 + 0.5), **more).normalized()


#: Fixed values: (preview, refine, candidates, distance, confidence) by preset and surface.
PRESETS = {
    ("desktop", "fast"): (960, 1536, 1, 0.20, 0.52),
    ("desktop", "balanced"): (1280, 2048, 2, 0.20, 0.52),
    ("desktop", "best"): (2048, 4096, 4, 0.20, 0.52),
    ("browser", "fast"): (960, 1536, 1, 0.22, 0.50),
    ("browser", "balanced"): (1280, 2048, 2, 0.20, 0.52),
    ("browser", "best"): (2048, 4096, 4, 0.18, 0.52),
}


def preset(name: str, surface: str = "desktop") -> ScanOptions:
    preview, refine, candidates, distance, confidence = PRESETS[surface, name]
    return ScanOptions(preview_size=preview, refine_size=refine, refine_candidates=candidates, max_duplicate_distance=distance, min_duplicate_confidence=confidence)


def preset_of(options: ScanOptions, surface: str = "desktop") -> str:
    """The preset these options are, or 'custom'."""
    key = (options.preview_size, options.refine_size, options.refine_candidates, options.max_duplicate_distance, options.min_duplicate_confidence)
    return next((name for (where, name), values in PRESETS.items() if where == surface and values == key), "custom")


def estimated_load(options: ScanOptions, cores: int, memory_gib: float) -> float:
    """How hard a scan with these options is on a machine, from 0 to 1: pixels, refinement and detector, weighted, over what the
    machine has of cores and memory in eighths."""
    options = options.normalized()
    pixels = (options.preview_size / 1280.0) ** 2
    refinement = (options.refine_size / 2048.0) ** 2 * options.refine_candidates / 2.0 if options.refine else 0.0
    by_detector = {"ml": 1.8 if options.detector_model == "accurate" else 1.1, "heuristic": 0.45, "auto": 0.45}
    limited = lambda x: min(max(x / 8.0, 0.35), 2.0)
    load = (0.42 * pixels + 0.40 * refinement + 0.18 * by_detector.get(options.detector, 0.1)) / (limited(cores) * limited(memory_gib))
    return min(max(load, 0.0), 1.0)
