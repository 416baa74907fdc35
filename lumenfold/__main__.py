"""Command line over :mod:`lumenfold.api`."""

from __future__ import annotations

import argparse
import json

from lumenfold import api
from lumenfold.functions.linalg import RECON_TO_CAPTURE
from lumenfold.operators.frames import IngestConfig
from lumenfold.session import get_session

NEEDED = {"required": True}
FLAG = {"action": "store_true"}
# Names of commands and options, and their defaults.
COMMANDS = {
    "benchmark": ("collate metric files", {"--eval-dir": NEEDED, "--no-markdown": FLAG}),
    "embodied": ("mesh for a simulator", {"--mesh": NEEDED, "--out": NEEDED, "--splat": {}, "--up": {"choices": ("y", "z"), "default": "y"}, "--scene-json": {}}),
    "fuse": (
        "fill gaps of a surface from another",
        {"--backbone": NEEDED, "--donor": NEEDED, "--out": NEEDED, "--tau": {"type": float, "default": 0.05}, "--depth": {"type": int, "default": 11}, "--donor-from-recon": FLAG},
    ),
    "ingest": (
        "keyframes of a clip given as a table of frames, or with --images as a folder of frame images",
        {"frames": {}, "--out": NEEDED, "--images": FLAG, "--target-frames": {"type": int, "default": 60}, "--stride": {"type": int, "default": 1}, "--blur-threshold": {"type": float, "default": 0.6}},
    ),
    "mesh": (
        "surface of a point file",
        {"--ply": NEEDED, "--out": NEEDED, "--density-quantile": {"type": float, "default": 0.04}, "--voxel": {"type": float, "default": 0.0}, "--target-tris": {"type": int, "default": 250_000}},
    ),
    "reconstruct": ("what reconstruction needs", {}),
    "viz": ("mesh within a triangle budget", {"--in": NEEDED | {"dest": "src"}, "--out": NEEDED, "--tris": {"type": int, "default": 300_000}}),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lumenfold")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name, (says, options) in COMMANDS.items():
        one = sub.add_parser(name, help=says)
        for option, settings in options.items():
            one.add_argument(option, **settings)
    return p


def run_benchmark(spark, a):
    return api.collate(spark, a.eval_dir, not a.no_markdown)


def run_embodied(spark, a):
    return api.export_for_sim(spark, a.mesh, a.out, a.splat, a.up, a.scene_json)


def run_fuse(spark, a):
    move = tuple((*row, 0.0) for row in RECON_TO_CAPTURE) if a.donor_from_recon else None
    return api.fuse_consensus(spark, a.backbone, a.donor, a.out, api.ConsensusConfig(tau=a.tau, poisson_depth=a.depth, donor_transform=move))


def run_ingest(spark, a):
    cfg = IngestConfig(target_frames=a.target_frames, sample_stride=a.stride, blur_rel_threshold=a.blur_threshold)
    return api.run_ingest(spark, a.frames if a.images else spark.read.parquet(a.frames), a.out, cfg, video=a.frames)


def run_mesh(spark, a):
    return api.mesh_points(spark, a.ply, a.out, a.density_quantile, a.voxel, a.target_tris)


def run_viz(spark, a):
    return api.decimate(spark, a.src, a.out, a.tris)


def main(argv: list[str] | None = None) -> dict | None:
    a = parser().parse_args(argv)
    if a.cmd == "reconstruct":
        print(api.RECONSTRUCT_HELP)
        return None
    out = globals()[f"run_{a.cmd}"](get_session(), a)
    if a.cmd != "benchmark":  # which prints its table
        print(json.dumps(out, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
