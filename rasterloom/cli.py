"""Command line: encode, decode, info, check, compare and demo over image files and y4m clips.

    python -m rasterloom encode IN OUT | decode IN OUT | info FILE | check FILE [--frames N] | compare FILE | demo
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

import numpy as np

from rasterloom.operators import codec
from rasterloom.sources import images, y4m

RATE = 25_000  # samples a second that one core codes, about


def load(path: str, frames: int | None = None, force: bool = False) -> tuple[str, list, y4m.Header | None]:
    data = Path(path).read_bytes()
    if data.startswith(y4m.MAGIC):
        return "clip", list(y4m.frames(data, frames)), y4m.parse_header(data)
    image = images.decode(data, force)
    return "image", [image[:, :, k] for k in range(image.shape[2])], None


def encode(kind: str, media: list) -> bytes:
    return codec.encode_clip([list(f) for f in media]) if kind == "clip" else codec.encode_image(media)


def restore(data: bytes, path: str) -> None:
    if data[:4] == codec.CLIP:
        frames = codec.decode_clip(data)
        shapes = [p.shape for p in frames[0]]
        by_steps = {tuple(y4m.Header(shapes[0][1], shapes[0][0], c).shapes()): c for c in ("mono", "444", "422", "420jpeg")}
        colour = by_steps.get(tuple(shapes))
        if colour is None:
            raise ValueError("these planes have no y4m form")
        Path(path).write_bytes(y4m.write(frames, y4m.Header(shapes[0][1], shapes[0][0], colour)))
        return
    image = np.stack(codec.decode_image(data), axis=2)
    Path(path).write_bytes(images.write_png(image) if path.endswith(".png") else images.write_pnm(image))


def describe(data: bytes) -> str:
    h = codec.header(data)
    return f"{h['kind']}: {h['frames']} frames, {h['width']}x{h['height']}, {h['planes']} planes, colour transform {'on' if h['colour'] else 'off'}, {len(data)} bytes, {8 * len(data) / h['samples']:.3f} bits a sample"


def check(kind: str, media: list) -> tuple[bool, str]:
    blob = encode(kind, media)
    back = codec.decode_clip(blob) if kind == "clip" else codec.decode_image(blob)
    flat = lambda m: [p for f in m for p in f] if kind == "clip" else m
    same = len(flat(back)) == len(flat(media)) and all(np.array_equal(a, b) for a, b in zip(flat(back), flat(media)))
    raw = sum(p.size for p in flat(media))
    return same, f"{raw} bytes to {len(blob)} ({raw / len(blob):.2f}x), {'every sample identical' if same else 'DIFFERENT'}"


def sample_image(width: int = 96, height: int = 64) -> np.ndarray:
    """A seeded picture: a smooth field, a disc, a band, grain and a tiled patch."""
    rng = np.random.default_rng(7)
    y, x = np.mgrid[:height, :width]
    field = 90 + 60 * np.sin(x / 31) + 40 * np.cos(y / 23) + 60 * ((x - width / 3) ** 2 + (y - height / 2) ** 2 < (height / 4) ** 2) - 30 * (abs(y - height * 0.8) < 3)
    image = np.stack([field, field + 12, field - 18], axis=2) + rng.normal(0, 3, (height, width, 1))
    image[:32, -32:] = np.tile(rng.integers(0, 256, (16, 16, 3)), (2, 2, 1))
    return np.clip(image, 0, 255).astype(np.uint8)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rasterloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, names in (("encode", ("source", "target")), ("decode", ("source", "target")), ("info", ("source",)), ("check", ("source",)), ("compare", ("source",)), ("demo", ())):
        sub = commands.add_parser(name)
        for n in names:
            sub.add_argument(n)
        if name in ("encode", "check"):
            sub.add_argument("--frames", type=int, default=None)
            sub.add_argument("--force", action="store_true", help="read 16-bit images with 8 bits")
    args = parser.parse_args(argv)
    try:
        if args.command == "encode":
            kind, media, _ = load(args.source, args.frames, args.force)
            samples = sum(p.size for p in ([q for f in media for q in f] if kind == "clip" else media))
            if samples > 60 * RATE:
                print(f"about {samples // RATE} s of work", file=sys.stderr)
            blob = encode(kind, media)
            Path(args.target).write_bytes(blob)
            print(describe(blob))
        elif args.command == "decode":
            restore(Path(args.source).read_bytes(), args.target)
        elif args.command == "info":
            print(describe(Path(args.source).read_bytes()))
        elif args.command in ("check", "demo"):
            kind, media = load(args.source, args.frames, args.force)[:2] if args.command == "check" else ("image", list(np.moveaxis(sample_image(), 2, 0)))
            same, text = check(kind, media)
            print(text)
            return 0 if same else 2
        else:
            from rasterloom.plans.studies import CODECS

            kind, media, _ = load(args.source)
            if kind != "image" or len(media) not in (1, 3):
                raise ValueError("compare takes gray and RGB images")
            raw = sum(p.size for p in media)
            for n, name in sorted((len(f(media)[0]), name) for name, f in CODECS.items()):
                print(f"{name:8} {n:10} bytes {raw / n:6.2f}x")
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0
