"""Command line: detect, quantify, generate-config, list-kernels, view, convert, test. Maps are folders of bins and pixels as Parquet."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

import numpy as np

from gridloom import __version__

_AUTO = ("min_dist", "max_dist", "pearson", "min_separation", "max_iterations", "max_perc_zero", "max_perc_undetected")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("gridloom", description=__doc__)
    top.add_argument("--version", action="version", version=__version__)
    commands = top.add_subparsers(dest="command", required=True)

    def with_map(name: str, text: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        p.add_argument("map")
        p.add_argument("--norm", choices=("auto", "raw", "force"), default="auto")
        p.add_argument("--threads", default="*")
        p.add_argument("--n-mads", type=float, default=5.0, help="bins whose log marginal lies further below the median aren't balanced")
        return p

    def with_kernel(p: argparse.ArgumentParser) -> None:
        p.add_argument("--pattern", default="loops")
        p.add_argument("--kernel-config")
        p.add_argument("--win-fmt", choices=("json", "npy"), default="json")
        p.add_argument("--plan", choices=("scatter", "tile"), default="tile")
        for option in _AUTO:
            names = ["--" + option.replace("_", "-")]
            if option.startswith("max_") and option != "max_dist":
                names.append(names[0].replace("max-", ""))  # --iterations, --perc-zero, --perc-undetected
            p.add_argument(*names, dest=option, default="auto")
        p.add_argument("--win-size", default="auto", help="resize the kernels to this width")
        p.add_argument("--no-plotting", action="store_true", help="no drawing of the mean window")
        p.add_argument("--subsample", type=float, help="a share below or equal to 1, or a number of contacts")
        p.add_argument("--tsvd", type=float, nargs="?", const=0.999, help="share of the kernels' energy to keep (0.999)")
        p.add_argument("--seed", type=int, default=0)

    detect = with_map("detect", "find patterns")
    detect.add_argument("prefix")
    with_kernel(detect)
    detect.add_argument("--inter", action="store_true", help="also between chromosomes")
    detect.add_argument("--smooth-trend", action="store_true")
    detect.add_argument("--dump")
    detect.add_argument("--resume", help="the --dump folder of an earlier run over the same map: go on from its signal")
    detect.add_argument("--chroms", help="only these chromosomes, separated by commas; no others are read")
    detect.add_argument("--kernel-factor", type=float)
    quantify = with_map("quantify", "score given positions")
    quantify.add_argument("positions", help="BED2D file")
    quantify.add_argument("prefix")
    quantify.add_argument("--inter", action="store_true", help="also score pairs between chromosomes")
    with_kernel(quantify)
    config = commands.add_parser("generate-config", help="write a configuration, from a preset or from positions of a map")
    config.add_argument("prefix")
    config.add_argument("--preset", default="loops")
    config.add_argument("--map")
    config.add_argument("--positions", help="BED2D file: positions whose mean window is the kernel")
    config.add_argument("--win-size", type=int)
    config.add_argument("--chroms", help="comma-separated: only positions of these chromosomes")
    config.add_argument("--inter", action="store_true", help="also positions between chromosomes")
    config.add_argument("--norm", choices=("auto", "raw", "force"), default="auto")
    config.add_argument("--n-mads", type=float, default=5.0)
    config.add_argument("--threads", default="*")
    listing = commands.add_parser("list-kernels", help="presets")
    listing.add_argument("--long", action="store_true")
    listing.add_argument("--mat", action="store_true")
    listing.add_argument("--name")
    view = with_map("view", "a region as text")
    view.add_argument("--region", required=True, help="chrom:start-end, the rows")
    view.add_argument("--region2", help="chrom:start-end, the columns; the rows' region without it")
    view.add_argument("--patterns", help="table of detected patterns, shown as X")
    view.add_argument("--log", action="store_true")
    convert = commands.add_parser("convert", help="a map folder from dumped tables of bins and pixels, or from an HDF5 map")
    convert.add_argument("source", nargs="+", help="the tables of bins and of pixels, or one HDF5 map (file.cool, file.mcool::/resolutions/1000)")
    convert.add_argument("map")
    commands.add_parser("test", help="detect planted loops in a synthetic map")
    return top


def ascii_matrix(matrix: np.ndarray, glyphs: str = " .:-=+*#%@") -> str:
    """Glyphs by the share of cells with less."""
    flat = np.sort(matrix, axis=None)
    level = (np.searchsorted(flat, matrix) / flat.size * len(glyphs)).astype(int)
    return "\n".join("".join(glyphs[k] for k in row) for row in level)


def _config(args: argparse.Namespace):
    from gridloom.sources.kernels import load_config, overridden, resize

    config = load_config(args.kernel_config, custom=True) if args.kernel_config else load_config(args.pattern)
    config = overridden(config, **{k: getattr(args, k) for k in _AUTO})
    if args.win_size in (None, "auto"):
        return config
    return replace(config, kernels=[resize(k, int(args.win_size) / k.shape[0]) for k in config.kernels])


def _sampled(cmap, amount: float | None, seed: int):
    """A share of the contacts of each sub-matrix; a number of contacts is taken as a share of all."""
    from pyspark.sql import functions as F

    from gridloom.operators.sampling import draw_share

    if amount is None:
        return cmap
    if amount <= 0:
        raise ValueError("--subsample must be above 0")
    if amount > 1:
        amount /= cmap.pixels.agg(F.sum("count")).first()[0] or 1.0
        if amount > 1:
            raise ValueError("more contacts asked for than there are")
    return replace(cmap, pixels=draw_share(cmap.pixels, cmap.chroms, amount, seed))


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from gridloom.sources import kernels, sinks

    if args.command == "list-kernels":
        names = [args.name] if args.name else sorted(kernels.PRESETS)
        for name in names:
            config = kernels.load_config(name)
            print(config if args.long else name)
            if args.mat:
                print("\n\n".join(ascii_matrix(k) for k in config.kernels))
        return 0
    if args.command == "generate-config" and not args.map:
        config = kernels.load_config(args.preset)
        shapes = [kernels.resize(k, args.win_size / k.shape[0]) if args.win_size else k for k in config.kernels]
        print(sinks.write_config(_plain(config), shapes, args.prefix))
        return 0

    from pyspark.sql import functions as F

    from gridloom.operators.balance import normalise
    from gridloom.plans import pipeline
    from gridloom.session import build_session
    from gridloom.sources.contacts import of_chromosomes, read_bed2d, read_dump, read_map, write_map, write_weights
    from gridloom.sources.datasource import read_cool

    spark = build_session("gridloom", getattr(args, "threads", "*"))
    spark.sparkContext.setLogLevel("ERROR")
    if args.command == "test":
        from gridloom.synth import synthetic_map

        cmap, places = synthetic_map(spark)
        config = replace(kernels.load_config("loops_small"), max_dist=45_000, min_dist=2000, max_perc_zero=30)
        rows = pipeline.detect(cmap, config)[0].collect()
        found = sum(any(abs(r.bin1 - a) <= 1 and abs(r.bin2 - b) <= 1 for r in rows) for a, b in places)
        print(f"{found} of {len(places)} planted loops detected, {len(rows)} patterns in all")
        return int(found < len(places) * 0.8)
    if args.command == "convert":
        if len(args.source) > 2:
            raise ValueError("convert takes two tables or one HDF5 map")
        write_map(read_dump(spark, *args.source) if len(args.source) == 2 else read_cool(spark, args.source[0]), args.map)
        return 0
    if args.command == "generate-config":
        if not args.positions:
            raise ValueError("a map needs --positions")
        base = kernels.load_config(args.preset)
        size = (args.win_size or base.kernels[0].shape[0]) | 1
        cmap = normalise(read_map(spark, args.map), args.norm, n_mads=args.n_mads, inter=args.inter)
        places = read_bed2d(spark, args.positions)
        if args.chroms:
            places = places.where(F.col("chrom1").isin(args.chroms.split(",")) & F.col("chrom2").isin(args.chroms.split(",")))
        config = pipeline.make_config(cmap, base, places, size, raw=args.norm == "raw", inter=args.inter)
        print(sinks.write_config(_plain(config), config.kernels, args.prefix))
        return 0
    cmap = read_map(spark, args.map)
    if args.command == "view":
        print(_view(cmap, args))
        return 0
    sinks.check_prefix(args.prefix)
    config = _config(args)
    cmap = normalise(cmap, args.norm, n_mads=args.n_mads, inter=args.inter)
    if args.norm == "force":
        write_weights(cmap, args.map)
        cmap = read_map(spark, args.map)
    if args.command == "detect" and args.chroms:
        cmap = of_chromosomes(cmap, args.chroms.split(","))
    cmap = _sampled(cmap, args.subsample, args.seed)
    raw = args.norm == "raw"
    if args.command == "detect":
        if args.dump and args.subsample:
            cmap = replace(cmap, pixels=sinks.dump_stage(cmap.pixels, args.dump, "00_subsampled"))
        patterns, _ = pipeline.detect(cmap, config, raw=raw, smooth=args.smooth_trend, plan=args.plan, dump=args.dump, factor=args.kernel_factor, inter=args.inter, tsvd=args.tsvd, with_windows=True, resume=args.resume)
        rows, order = patterns.persist(), ["order"]
        sinks.write_patterns(rows.drop("window"), args.prefix, order=order)
    else:
        rows, order = pipeline.quantify(cmap, config, read_bed2d(spark, args.positions), raw=raw, inter=args.inter, tsvd=args.tsvd).persist(), ["bin1", "bin2"]
        sinks.write_patterns(rows.drop("window"), args.prefix, order=order)
    _write_windows(rows, order, config, args)
    print(f"{rows.count()} patterns {'detected' if args.command == 'detect' else 'scored'}", file=sys.stderr)
    return 0


def _write_windows(rows, order: list[str], config, args: argparse.Namespace) -> None:
    """One window a pattern, in the order of the table, and a drawing of their mean. The driver holds a window at a time, and
    as Spark fetches them, a partition's rows."""
    from gridloom.operators.windows import to_numpy
    from gridloom.sources import sinks

    first = rows.where("window IS NOT NULL").select("window").first()
    size, n = len(first.window) if first else config.kernels[0].shape[0], rows.count()
    total, seen = np.zeros((size, size)), np.zeros((size, size))

    def each():
        for r in rows.orderBy(*order).select("window").toLocalIterator():
            w = to_numpy([r], size)[0] if r.window else np.full((size, size), np.nan)
            total[:] += np.nan_to_num(w)
            seen[:] += np.isfinite(w)
            yield w

    sinks.stream_windows(each(), n, (size, size), args.prefix, args.win_fmt)
    if args.no_plotting or not seen.any():
        return
    pile = np.where(seen > 0, total / np.maximum(seen, 1), np.nan)
    if not config.max_dist:  # cells below the diagonal are missing
        full = np.nan_to_num(pile)
        pile = full + full.T - np.diag(np.diag(full))
    sinks.save_pileup(pile, args.prefix, f"Pileup of {n} {config.name}")


def _view(cmap, args: argparse.Namespace) -> str:
    from pyspark.sql import functions as F

    from gridloom.sources.contacts import of_chromosomes

    ends = []
    for region in (args.region, args.region2 or args.region):
        chrom, start, end = region.replace("-", ":").split(":")
        inside = cmap.bins.where((F.col("chrom") == chrom) & (F.col("start") >= int(start)) & (F.col("end") <= int(end)))
        low, high = inside.agg(F.min("bin_id"), F.max("bin_id")).first()
        if low is None or high - low > 500:
            raise ValueError("the region has no bins, or over 500")
        ends.append((low, high))
    (a, b), (c, d) = ends
    names = {region.split(":")[0] for region in (args.region, args.region2 or args.region)}
    cmap = of_chromosomes(cmap, sorted(names))  # reads no others
    matrix = np.zeros((b - a + 1, d - c + 1))
    turned = cmap.pixels.select(F.col("bin2_id").alias("bin1_id"), F.col("bin1_id").alias("bin2_id"), "count")
    both = cmap.pixels.select("bin1_id", "bin2_id", "count").unionByName(turned.where("bin1_id <> bin2_id"))
    for r in both.where(F.col("bin1_id").between(a, b) & F.col("bin2_id").between(c, d)).toLocalIterator():
        matrix[r[0] - a, r[1] - c] = np.log1p(r[2]) if args.log else r[2]
    lines = [list(x) for x in ascii_matrix(matrix).split("\n")]
    if args.patterns:
        with open(args.patterns) as f:
            head = f.readline().rstrip("\n").split("\t")
            at = [head.index("bin1"), head.index("bin2")]
            for line in f:
                x, y = (line.rstrip("\n").split("\t")[k] for k in at)
                for i, j in ((x, y), (y, x)):
                    if i and j and a <= int(i) <= b and c <= int(j) <= d:
                        lines[int(i) - a][int(j) - c] = "X"
    return "\n".join("".join(x) for x in lines)


def _plain(config) -> dict:
    from dataclasses import asdict

    return {k: v for k, v in asdict(config).items() if k != "kernels"}


if __name__ == "__main__":
    sys.exit(main())
