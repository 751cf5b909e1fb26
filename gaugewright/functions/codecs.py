"""Steps that need an image library: JPEG, blur, resampling, sharpening. Without it they raise; nothing imitates them."""

from __future__ import annotations

import io

import numpy as np

from gaugewright.functions.kernels import Picture, sobel


class CodecMissing(RuntimeError):
    """The optional image library isn't installed."""


def library():
    try:
        from PIL import Image, ImageEnhance, ImageFilter
    except ImportError as e:
        raise CodecMissing("this step needs Pillow, which isn't installed") from e
    return Image, ImageEnhance, ImageFilter


def available() -> bool:
    try:
        library()
    except CodecMissing:
        return False
    return True


def apply_step(rgb: np.ndarray, operation: str, p: dict, seed: int) -> np.ndarray:
    """One recipe step on an RGB array in [0, 1]."""
    if operation == "gaussian_noise":
        from gaugewright.functions.kernels import noisy

        return noisy(rgb, float(p["sigma"]), seed)
    image_lib, enhance, filters = library()
    image = image_lib.fromarray(np.rint(np.clip(rgb, 0, 1) * 255).astype(np.uint8), "RGB")
    size = image.size
    if operation == "jpeg":
        buffer = io.BytesIO()
        image.save(buffer, format="JPEG", quality=int(p["quality"]), subsampling=int(p["subsampling"]))
        image = image_lib.open(io.BytesIO(buffer.getvalue())).convert("RGB")
    elif operation == "gaussian_blur":
        image = image.filter(filters.GaussianBlur(float(p["sigma"])))
    elif operation == "resize":
        small = tuple(max(1, round(n * float(p["scale"]))) for n in size)
        image = image.resize(small, image_lib.Resampling.LANCZOS).resize(size, image_lib.Resampling.LANCZOS)
    elif operation == "color_jitter":
        for kind, key in ((enhance.Brightness, "brightness"), (enhance.Contrast, "contrast"), (enhance.Color, "saturation")):
            image = kind(image).enhance(float(p[key]))
    elif operation == "center_crop":
        w, h = (max(1, round(n * float(p["retain"]))) for n in size)
        left, top = (size[0] - w) // 2, (size[1] - h) // 2
        image = image.crop((left, top, left + w, top + h)).resize(size, image_lib.Resampling.BICUBIC)
    elif operation == "unsharp_mask":
        image = image.filter(filters.UnsharpMask(radius=float(p["radius"]), percent=int(p["percent"]), threshold=int(p["threshold"])))
    else:
        raise KeyError(operation)
    return np.asarray(image, dtype=np.float64) / 255.0


def apply_recipe(rgb: np.ndarray, steps: list[dict], parent: str, base_seed: int) -> np.ndarray:
    """Steps in order; equal steps are told apart by their occurrence, so a step's noise doesn't depend on its place."""
    import hashlib

    from gaugewright.operators.recipes import token

    seen: dict[str, int] = {}
    for step in steps:
        name = token(step)
        occurrence = seen[name] = seen.get(name, -1) + 1
        digest = hashlib.sha256(f"{base_seed}:{parent}:step:{name}:{occurrence}".encode()).digest()
        rgb = apply_step(rgb, step["operation"], step["parameters"], int.from_bytes(digest[:8], "big") % (1 << 32))
    return rgb


def self_probe(p: Picture, name: str) -> float:
    """What a codec, blur or rescale probe changes."""
    steps = {"self_jpeg70": ("jpeg", {"quality": 70, "subsampling": 2}), "self_blur1": ("gaussian_blur", {"sigma": 1.0}), "self_resize05": ("resize", {"scale": 0.5})}
    kind = next(k for k in steps if name.startswith(k))
    probe = Picture(apply_step(p.rgb, *steps[kind], 0)).luma
    if name.endswith("mse"):
        return float(((p.luma - probe) ** 2).mean())
    energy = p.gradient[2].mean()
    return float((energy - sobel(probe)[2].mean()) / (energy + 1e-12))


def analysis_view(rgb: np.ndarray, view: str) -> np.ndarray:
    """canonical_128 or native_capped (long side 256)."""
    image_lib, _, _ = library()
    image = image_lib.fromarray(np.rint(rgb * 255).astype(np.uint8), "RGB")
    if view == "canonical_128":
        image = image.resize((128, 128), image_lib.Resampling.LANCZOS)
    elif max(image.size) > 256:
        scale = 256 / max(image.size)
        image = image.resize(tuple(max(1, round(n * scale)) for n in image.size), image_lib.Resampling.LANCZOS)
    return np.asarray(image, dtype=np.float64) / 255.0
