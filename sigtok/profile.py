"""Codec profile, model identity and network configuration: the fixed parameters of a run."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass, replace
from typing import Any

import numpy as np

from sigtok.errors import SigtokError
from sigtok.shapes import Number, Text, Whole, checked

#: The shape of a field by the type of its default.
FIELD_SHAPES = {int: Whole(0, 2**63 - 1), float: Number(), str: Text(256)}


@dataclass(frozen=True)
class Profile:
    """How a read becomes windows and tokens, and how it comes back."""

    # The released geometry and names, which file headers must state in these words.
    sample_rate_hz: int = 5000
    chunk_samples: int = 8192
    overlap_samples: int = 144
    hop_samples: int = 8048
    tokens_per_chunk: int = 512
    codebook_size: int = 65536
    code_dtype: str = "uint16"
    normalization: str = "minmax_pm1"
    normalization_epsilon: float = 1e-6
    padding: str = "reflect"
    tail: str = "shift_last"
    stitch: str = "linear_edges_v1"
    quantization: str = "hard_v1"
    adc_conversion: str = "rint_clip_int16"

    def __post_init__(self) -> None:
        check_geometry(self.chunk_samples, self.hop_samples)
        if self.hop_samples != self.chunk_samples - self.overlap_samples:
            raise SigtokError("the hop must be the window length less the overlap")

    @classmethod
    def of(cls, length: int, overlap: int, tokens: int, codebook_size: int = 65536) -> Profile:
        return cls(
            chunk_samples=length,
            overlap_samples=overlap,
            hop_samples=length - overlap,
            tokens_per_chunk=tokens,
            codebook_size=codebook_size,
        )

    def to_json_dict(self) -> dict[str, Any]:
        return asdict(self)

    @staticmethod
    def json_shape() -> dict[str, Any]:
        """The shape of a profile's JSON object: all fields and no others."""
        return {name: FIELD_SHAPES[type(default)] for name, default in asdict(PROFILE).items()}

    @classmethod
    def from_json_dict(cls, data: Any) -> Profile:
        return cls(**checked(data, cls.json_shape(), "the profile"))


def check_geometry(length: int, hop: int) -> None:
    """Windows have a positive length and a hop within it."""
    if length <= 0 or not 0 < hop <= length:
        raise SigtokError(f"windows of {length} samples can't have a hop of {hop}")


#: The released geometry, and a small one for short sequences.
PROFILE = Profile()
SMALL = Profile.of(64, 16, 16)


@dataclass(frozen=True)
class ModelIdentity:
    """Which codec wrote a token file."""

    repo_id: str = "local/mean-quant"
    revision: str = "0" * 40
    architecture: str = "MeanQuant"
    model_type: str = "segment-means"
    codebook_size: int = 65536

    def to_json_dict(self) -> dict[str, Any]:
        return asdict(self)


@dataclass(frozen=True)
class NetworkConfig:
    """The network's shape. Defaults hold for keys that a configuration leaves out."""

    # The keys of a configuration and what holds where they are left out.
    enc_channels: tuple[int, ...] = (32, 64, 128, 256, 512)
    enc_down_strides: tuple[int, ...] = (2, 2, 2, 3)
    enc_stage_num_res_blocks: tuple[int, ...] = (2, 2, 3, 3)
    enc_kernel_size: int = 7
    encoder_use_block_norm: bool = True
    encoder_use_input_norm: bool = True
    encoder_use_transition_norm: bool = True
    latent_dim: int = 512
    latent_bilstm_layers: int = 2
    latent_bilstm_hidden_dim: int = 256
    quantizer_dim: int = 512
    codebook_size: int = 16384
    quant_conv_kernel_size: int = 7
    post_quant_conv_kernel_size: int = 7
    dec_channels: tuple[int, ...] = (512,)
    decoder_dim: int = 512
    decoder_intermediate_dim: int = 1536
    decoder_num_layers: int = 12
    decoder_pos_net_enabled: bool = True
    decoder_pos_net_attention_heads: int = 12
    istft_n_fft: int = 512
    istft_hop_length: int = 24
    istft_sample_rate: float = 5000.0
    istft_band_edges_hz: tuple[float, ...] = (200.0, 500.0, 1000.0)
    istft_band_gain_init: tuple[float, ...] = (1.0, 0.8, 0.45, 0.12)
    istft_dynamic_gate_scale: float = 0.5
    residual_correction_enabled: bool = True
    residual_correction_alpha_max: float = 0.1
    residual_correction_hidden_dim: int = 128
    diveq_sigma2: float = 1e-3

    @classmethod
    def from_mapping(cls, given: Mapping[str, Any]) -> NetworkConfig:
        """Given keys over the defaults; a nested residual_correction stands over its flat keys."""
        nested = given.get("residual_correction") or {}
        told = {**given, **{f"residual_correction_{key}": value for key, value in nested.items()}}
        base = cls()
        return replace(base, **{name: _like(default, told[name]) for name, default in vars(base).items() if name in told})

    @property
    def downsample_factor(self) -> int:
        return math.prod(self.enc_down_strides)

    def tokens_for(self, samples: int) -> int:
        """Encoder output length: rounding up at each stride is rounding up once, by their product."""
        return -(-samples // self.downsample_factor)

    def band_stops(self) -> list[int]:
        """The first bin beyond each band but the last: a band holds the bins up to its edge, the first one bin 0."""
        edges = np.asarray(self.istft_band_edges_hz) * self.istft_n_fft / self.istft_sample_rate
        return np.maximum(1, np.searchsorted(np.arange(self.istft_n_fft // 2 + 1), edges, side="right")).tolist()

    def band_ids(self) -> list[int]:
        """The band of each bin: how many bands stop at or before it."""
        stops = np.maximum.accumulate(self.band_stops())
        return np.searchsorted(stops, np.arange(self.istft_n_fft // 2 + 1), side="right").tolist()


def _like(default: Any, value: Any) -> Any:
    """``value`` in the type of a default, entry by entry in a tuple."""
    if isinstance(default, tuple):
        return tuple(_like(default[0], v) for v in value)
    return type(default)(value)


#: The released network differs from the defaults in these.
RELEASED_NETWORK = NetworkConfig(enc_down_strides=(2, 2, 2, 2), istft_hop_length=16, codebook_size=65536)
