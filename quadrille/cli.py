"""Command line: demo, bench, plan, export, serve over the simulated drive."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import telemetry
from .config import Lod, Model, Sensor, Settings
from .operators import metrics, navigation
from .plans.pipeline import MapPipeline
from .sources import scans, simulator
from .storage import cut


def settings(args: argparse.Namespace) -> Settings:
    rings = tuple(float(r) for r in args.rings.split(",")) if args.rings else Lod().ring_radii
    return Settings(lod=Lod(base_cell=args.base_cell, n_levels=len(rings), ring_radii=rings), model=Model(backend=args.backend), sensor=Sensor(azimuth_steps=args.azimuth_steps), seed=args.seed)


def session() -> SparkSession:
    s = SparkSession.builder.appName("quadrille").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def drive(spark: SparkSession, s: Settings, frames: int):
    """(pose, result) of each frame of a simulated drive."""
    street = simulator.Street.make(s.seed)
    pipe = MapPipeline(spark, s)
    for k in range(frames):
        points, poses = simulator.scans(spark, range(k, k + 1), s.seed, s.sensor, street)
        pose = poses.first().asDict()
        yield pose, pipe.process(points.withColumnRenamed("label", "gt"), pose), pipe, street


def demo(args: argparse.Namespace) -> int:
    s = settings(args)
    print("frame points cells accuracy seconds")
    for pose, result, _, _ in drive(session(), s, args.frames):
        a = result.points.agg(F.count("*").alias("n"), F.avg((F.col("refined_label") == F.col("gt")).cast("double")).alias("a")).first()
        print(pose["frame_index"], a["n"], result.cells.count(), f"{a['a']:.3f}", f"{result.seconds['total']:.1f}")
    return 0


def bench(args: argparse.Namespace) -> int:
    """Scores, errors and audit of a drive, as JSON and as tables."""
    s, spark = settings(args), session()
    found, last = None, None
    for k, (pose, result, pipe, street) in enumerate(drive(spark, s, args.frames)):
        last = (pose, result, pipe, street)
        if k < args.warmup:
            continue
        c = metrics.confusion(result.points, "gt", "refined_label")
        found = c if found is None else found.unionByName(c)
    pose, result, pipe, street = last
    scores = metrics.scores(found.groupBy("gt", "pred").agg(F.sum("n").alias("n")))
    errors = metrics.elevation_error(result.verdicts.where("passable"), street.height(F.col("cx"), F.col("cy")), pose["ox"], pose["oy"])
    parts = {"scores": scores, "elevation": errors, "levels": metrics.level_histogram(result.cells, s.lod), "memory": pipe.memory()}
    report = {name: [r.asDict() for r in df.collect()] for name, df in parts.items()} | {"frames": pipe.history}
    print("\n".join(f"## {name}\n\n{scans.markdown(df)}" for name, df in parts.items()))
    if args.json:
        with open(args.json, "w") as f:
            json.dump(report, f, indent=2)
    return 0


def plan(args: argparse.Namespace) -> int:
    """A route over the last frame's map: its summary and some dozen of its tiles."""
    s, spark = settings(args), session()
    *_, (pose, result, _, _) = drive(spark, s, args.frames)
    gx, gy = pose["ox"] + args.ahead, pose["oy"] + args.lateral
    goal = spark.createDataFrame([(0, pose["ox"], pose["oy"], gx, gy)], "request long, sx double, sy double, gx double, gy double")
    found = cut(navigation.routes(result.tiles, goal, s.vehicle))
    rows = navigation.route_summary(found).collect()
    if not rows:
        print(f"no route to ({gx:.1f}, {gy:.1f}): no passable terrain connects it with the vehicle")
        return 1
    r = rows[0]
    print(f"route: {r['tiles']} tiles, {r['length']:.1f} m long, {r['climb']:.2f} m climbed, {found.first()['expanded']} tiles looked at")
    for t in navigation.every_nth(found).orderBy("seq").collect():
        print(f"  {t['x'] - pose['ox']:8.1f} {t['y'] - pose['oy']:8.1f}  z={t['z']:.2f}")
    return 0


def export(args: argparse.Namespace) -> int:
    s, spark = settings(args), session()
    frames = [scans.payload(result.points).first().asDict() for _, result, _, _ in drive(spark, s, args.frames)]
    with open(args.out, "w") as f:
        json.dump({"settings": json.loads(s.to_json()), "frames": frames}, f)
    return 0


PAGE = "<!doctype html><title>quadrille</title><h1>quadrille</h1><pre id=d></pre><script>const data=/*DATA*/;document.getElementById('d').textContent=Object.keys(data)+' '+(data.frames||[]).length</script>"


def pages(data: str, benchmark: str | None, config: str) -> dict:
    """Path -> (kind, function that makes the body)."""
    plain = lambda text: lambda: text.encode()
    return {
        "/": ("text/html", plain(scans.artifact(PAGE, json.loads(data)))),
        "/healthz": ("application/json", plain('{"ok": true}')),
        "/api/data": ("application/json", plain(data)),
        "/api/benchmark": ("application/json", plain(benchmark or "{}")),
        "/api/config": ("application/json", plain(config)),
        "/api/telemetry": ("application/json", lambda: json.dumps(telemetry.system()).encode()),
    }


def server(found: dict, port: int):
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            kind, body = found.get(self.path.split("?")[0], ("application/json", None))
            self.send_response(200 if body else 404)
            self.send_header("Content-Type", kind)
            self.end_headers()
            self.wfile.write(body() if body else b"{}")

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


def serve(args: argparse.Namespace) -> int:
    """An exported payload, a bench report, the settings and the host's figures over HTTP."""
    texts = []
    for name in (args.data, args.report):
        if name:
            with open(name, encoding="utf-8") as f:
                texts.append(f.read())
        else:
            texts.append(None)
    server(pages(*texts, settings(args).to_json()), args.port).serve_forever()
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quadrille")
    commands = top.add_subparsers(dest="command", required=True)
    for name, f, frames in (("demo", demo, 4), ("bench", bench, 6), ("plan", plan, 6), ("export", export, 4), ("serve", serve, 0)):
        c = commands.add_parser(name, help=(f.__doc__ or name))
        c.set_defaults(run=f)
        c.add_argument("--seed", type=int, default=7)
        c.add_argument("--backend", default="auto", choices=["auto", "numpy"])
        c.add_argument("--base-cell", type=float, default=0.05)
        c.add_argument("--rings", default="")
        c.add_argument("--frames", type=int, default=frames)
        c.add_argument("--azimuth-steps", type=int, default=Sensor().azimuth_steps)
        if name == "bench":
            c.add_argument("--warmup", type=int, default=2)
            c.add_argument("--json")
        if name == "plan":
            c.add_argument("--ahead", type=float, default=30.0)
            c.add_argument("--lateral", type=float, default=0.0)
        if name == "export":
            c.add_argument("--out", default="payload.json")
        if name == "serve":
            c.add_argument("--data", required=True)
            c.add_argument("--report")
            c.add_argument("--port", type=int, default=8000)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
