"""Settings from the environment, an env file, or a dict."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import make_dataclass
from pathlib import Path

_TRUE = {"1", "true", "yes", "on"}


def _text(raw: str, default):
    return raw.strip() or default


def _flag(raw: str, default):
    return raw.strip().lower() in _TRUE if raw.strip() else default


def _number(kind: Callable):
    def read(raw: str, default):
        try:
            return kind(raw.strip())
        except ValueError:
            return default

    return read


def _names(raw: str, default):
    return tuple(x.strip() for x in raw.split(",") if x.strip()) or default


def _numbers(raw: str, default):
    try:
        return tuple(float(x) for x in raw.split(",") if x.strip()) or default
    except ValueError:
        return default


_INT, _REAL = _number(int), _number(float)

#: Field, key in the environment, default, reader, least and most where it is clamped.
SETTINGS = [
    ("model", "ASR_MODEL", "large-v3", _text),
    ("device", "ASR_DEVICE", "cuda", _text),
    ("compute_type", "ASR_COMPUTE_TYPE", "float16", _text),
    ("beam_size", "ASR_BEAM_SIZE", 5, _INT),
    ("cpu_threads", "ASR_CPU_THREADS", 2, _INT),
    ("asr_workers", "ASR_PARALLEL_WORKERS", 1, _INT, 1, 8),
    ("max_concurrent_requests", "MAX_CONCURRENT_REQUESTS", 2, _INT, 1, 8),
    ("download_root", "MODEL_CACHE_DIR", "/var/lib/whisper", _text),
    ("language", "ASR_LANGUAGE", "auto", _text),
    ("language_least", "ASR_LANGUAGE_MIN_CONFIDENCE", 0.5, _REAL),
    ("temperatures", "ASR_TEMPERATURES", (0.0, 0.2, 0.4, 0.6, 0.8, 1.0), _numbers),
    ("compression_most", "ASR_MAX_COMPRESSION_RATIO", 2.4, _REAL),
    ("logprob_least", "ASR_MIN_LOG_PROB", -1.0, _REAL),
    ("no_speech_threshold", "ASR_NO_SPEECH_THRESHOLD", 0.6, _REAL),
    ("skip_silence_s", "ASR_SKIP_SILENCE_LONGER_THAN_S", 2.0, _REAL),
    ("vad_threshold", "VAD_SPEECH_THRESHOLD", 0.5, _REAL),
    ("vad_min_speech_ms", "VAD_MIN_SPEECH_MS", 250, _INT),
    ("vad_min_silence_ms", "VAD_MIN_SILENCE_MS", 400, _INT),
    ("vad_pad_ms", "VAD_SPEECH_PAD_MS", 200, _INT),
    ("vad_block_s", "VAD_STREAM_BLOCK_S", 30.0, _REAL),
    ("vad_onnx", "VAD_USE_ONNX", True, _flag),
    ("chunk_most_s", "VAD_MAX_CHUNK_S", 28.0, _REAL),
    ("chunk_pad_s", "VAD_CHUNK_PAD_S", 0.2, _REAL),
    ("sound_enabled", "SOUND_EVENTS_ENABLED", True, _flag),
    ("sound_device", "SOUND_EVENTS_DEVICE", "cpu", _text),
    ("sound_rate", "SOUND_EVENTS_SAMPLE_RATE", 32_000, _INT),
    ("sound_window_s", "SOUND_EVENTS_WINDOW_S", 60.0, _REAL),
    ("sound_overlap_s", "SOUND_EVENTS_OVERLAP_S", 1.0, _REAL),
    ("sound_least", "SOUND_EVENTS_MIN_SCORE", 0.35, _REAL),
    ("sound_top_k", "SOUND_EVENTS_TOP_K", 3, _INT),
    ("sound_gap_s", "SOUND_EVENTS_MERGE_GAP_S", 0.6, _REAL),
    ("sound_min_s", "SOUND_EVENTS_MIN_DURATION_S", 0.5, _REAL),
    ("sound_exclude_speech", "SOUND_EVENTS_EXCLUDE_SPEECH", True, _flag),
    ("sound_allow", "SOUND_EVENTS_PROMPT_ALLOWLIST", (), _names),
    ("sound_workers", "SOUND_EVENTS_PARALLEL_WORKERS", 1, _INT, 1, 8),
    ("speakers_enabled", "SPEAKERS_ENABLED", False, _flag),
    ("speakers_device", "SPEAKERS_DEVICE", "cuda", _text),
    ("speakers_workers", "SPEAKERS_PARALLEL_WORKERS", 1, _INT, 1, 4),
    ("speakers_embed_workers", "SPEAKERS_EMBED_WORKERS", 1, _INT, 1, 8),
    ("speakers_window_s", "SPEAKERS_CHUNK_S", 600.0, _REAL),
    ("speakers_overlap_s", "SPEAKERS_CHUNK_OVERLAP_S", 30.0, _REAL),
    ("speakers_threshold", "SPEAKERS_LINK_THRESHOLD", 0.75, _REAL),
    ("speakers_min_speech_s", "SPEAKERS_LINK_MIN_SPEECH_S", 0.5, _REAL),
    ("hub_token", "HF_TOKEN", None, _text),
    ("port", "PORT", 8080, _INT),
    ("log_level", "LOG_LEVEL", "INFO", _text),
    ("align_enabled", "WORD_ALIGN_ENABLED", False, _flag),
    ("align_device", "WORD_ALIGN_DEVICE", None, _text),
    ("align_model", "WORD_ALIGN_MODEL", None, _text),
    ("align_interpolate", "WORD_ALIGN_INTERPOLATE_METHOD", "nearest", _text),
    ("align_language", "WORD_ALIGN_LANGUAGE", None, _text),
]

Config = make_dataclass("Config", [s[0] for s in SETTINGS], frozen=True)


def load(environ: Mapping[str, str] | None = None) -> Config:
    """Settings from ``environ`` (the process's own by default); what is unset, blank or unreadable has its default."""
    env = os.environ if environ is None else environ
    out = {}
    for field, key, default, read, *bounds in SETTINGS:
        value = read(env.get(key, ""), default)
        out[field] = max(bounds[0], min(value, bounds[1])) if bounds else value
    return Config(**out)


def forced_language(config: Config) -> str | None:
    """The configured language; ``auto``, ``none`` and blank mean none."""
    return None if config.language.lower() in {"", "auto", "none"} else config.language


def preload_languages(config: Config) -> tuple[str, ...]:
    """Languages whose alignment models to load first: the aligner's own, else the forced one, else English."""
    return (config.align_language or forced_language(config) or "en",)


def load_env_file(environ: dict | None = None, start: Path | None = None) -> Path | None:
    """Set variables from an env file; those that are set already stay.

    ENV_FILE or DOTENV_PATH name it (None if it is not there); else ``.env`` in the working folder or the
    nearest one above.  Lines are KEY=VALUE, with an optional ``export`` and quotes; ``#`` begins a comment.
    """
    env = os.environ if environ is None else environ
    named = env.get("ENV_FILE") or env.get("DOTENV_PATH")
    if named:
        path = Path(named).expanduser()
    else:
        here = (start or Path.cwd()).resolve()
        path = next((p / ".env" for p in (here, *here.parents) if (p / ".env").is_file()), here / ".env")
    if not path.is_file():
        return None
    for line in path.read_text(encoding="utf-8").splitlines():
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        if not eq or key.lstrip().startswith("#"):
            continue
        value = value.strip()
        if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1:
            value = value[1:-1]
        else:
            value = value.split(" #")[0].rstrip()
        env.setdefault(key.strip(), value)
    return path
