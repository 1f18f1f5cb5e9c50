"""Commands over a folder of books' tables, one stage each or all of them in order.

A folder holds one parquet table a stage: pages, chapters, cast_notes, cast, briefs, script, voices, voice_map, clips,
sound; a manifest.json tells which stages are done.

    python -m folioloom run FOLDER --epubs PATH [--from STAGE] [--only STAGE ...] [--until STAGE] [--chapters N ...] [--force] [--profile P]
    python -m folioloom extract|cast|attribute|voices|design|render|encode|publish FOLDER [...]
    python -m folioloom names FOLDER OPTIONS.json
    python -m folioloom score FOLDER GOLD PROFILE ...
    python -m folioloom fetch --settings FILE
"""

from __future__ import annotations

import argparse
import json
import subprocess
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom import providers
from folioloom.operators import attribution, casting, incremental, reading, roster, scoring, segmentation, sound, timeline, voices
from folioloom.sources import books as shelf
from folioloom.sources import epub, files

KINDS = {"cast": "text", "attribute": "text", "voices": "text", "design": "sound", "render": "sound"}


class Shelf:
    """The tables of a folder, and the stages that make them."""

    def __init__(self, spark: SparkSession, folder: str, options: argparse.Namespace, make: Callable[[], providers.Provider] | None = None):
        self.spark, self.folder, self.options = spark, folder, options
        self.settings = files.load_settings(options.settings, options.local, options.profile) if options.settings else {}
        self.make = make or providers.from_settings(self.settings)
        self.speech = sound.from_settings(self.settings)

    def has(self, name: str) -> bool:
        return Path(self.folder, name).exists()

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def write(self, name: str, rows: DataFrame) -> None:
        """A table anew; the old one is read while the new one is written beside it."""
        fresh = Path(self.folder, f"{name}.new")
        rows.write.mode("overwrite").parquet(str(fresh))
        old = Path(self.folder, name)
        if old.exists():
            old.rename(f"{old}.old")
        fresh.rename(old)
        subprocess.run(["rm", "-rf", f"{old}.old"], check=True)

    def renew(self, name: str, rows: DataFrame, keys: Sequence[str]) -> None:
        """A table whose rows of the keys in `rows` are replaced."""
        kept = self.read(name).join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows, True) if self.has(name) else rows
        self.write(name, kept)

    def chosen(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.col("n").isin(self.options.chapters)) if self.options.chapters else rows

    def members(self) -> DataFrame:
        cast = self.read("cast").withColumn("entry_id", F.col("ord").cast("bigint"))
        if self.has("briefs"):
            return cast.join(self.read("briefs").select("book_id", "id", "persona"), ["book_id", "id"], "left")
        return cast.withColumn("persona", F.lit(None).cast("string"))

    # ---- stages ----

    def extract(self) -> None:
        pages = epub.read_epubs(self.spark, self.options.epubs).withColumn("book_id", F.regexp_extract("path", r"([^/]+)\.epub$", 1))
        about = pages.groupBy("book_id").agg(F.first("package").alias("package"))
        self.write("books", about.select("book_id", *epub.metadata(F.col("package"))))
        self.write("chapters", epub.chapters(pages, "book_id", self.settings.get("heading", r"chapter\s")))

    def cast(self) -> None:
        if self.options.step in ("all", "collect"):
            done = self.read("cast_notes").where("delta IS NOT NULL") if self.has("cast_notes") else None
            notes = reading.collect(self.read("chapters"), self.make, done, max_tokens=self.settings.get("cast_max_tokens", 4096))
            self.write("cast_notes", notes)
            self.write("cast", reading.cast_of(self.read("cast_notes")))
        if self.options.step in ("all", "dedupe"):
            cast = self.read("cast").withColumn("entry_id", F.col("ord").cast("bigint"))
            merged = casting.merge_cast(cast, roster.dedupe_pairs(cast))
            self.write("cast", merged)
            self.write("suggested_merges", reading.suggested_merges(self.read("cast"), self.make))
        if self.options.step in ("all", "personas"):
            made = reading.personas(self.members(), self.read("books"), self.make).where("persona IS NOT NULL")
            self.renew("briefs", made.select("book_id", "id", "persona"), ["book_id", "id"])

    def attribute(self) -> None:
        chapters = self.chosen(self.read("chapters"))
        if not self.options.chapters and self.has("script"):
            chapters = incremental.not_done(chapters, self.read("script"), ["book_id", "n"])
        script = segmentation.segments(chapters, ["book_id", "n"])
        done = attribution.attribute(script, self.members(), roster.name_index(self.members()), self.make)
        self.renew("script", done.drop("overridden_now"), ["book_id", "n"])

    def voices(self) -> None:
        held = self.read("voices") if self.has("voices") else None
        held_map = self.read("voice_map") if self.has("voice_map") else None
        narration = voices.narration_line(self.read("chapters"))
        least = self.settings.get("min_lines", voices.MIN_LINES)
        made, mapped = voices.assigned_voices(self.read("script"), self.members(), self.read("books"), self.make, held, held_map, least, narration)
        self.write("voices", made)
        self.write("voice_map", mapped)

    def design(self) -> None:
        held = self.read("clips") if self.has("clips") else None
        self.renew("clips", sound.design_clips(self.read("voices"), self.speech, held), ["book_id", "id"])

    def render(self) -> None:
        rendered = self.read("sound") if self.has("sound") else self.read("script").limit(0)
        todo = sound.chapters_to_render(self.read("script"), rendered, self.options.chapters)
        plan = sound.reading_plan(self.read("script").join(todo, ["book_id", "n"], "left_semi"), self.read("voice_map"), self.read("voices"))
        self.renew("sound", sound.render(plan, self.read("clips"), self.read("voices"), self.speech), ["book_id", "n"])

    def encode(self) -> None:
        """Sound files, playlists, markers and listings under books/; encoded where the encoder's program is there."""
        lengths = self.read("sound").select("book_id", "n", F.floor(F.size("samples") * 1000 / F.col("rate")).cast("bigint").alias("ms"))
        entries = timeline.titled(lengths, self.read("chapters"))
        about = self.read("books")
        target = f"{self.folder}/books"
        placed = timeline.offsets(lengths).join(entries.select("book_id", "n", "title"), ["book_id", "n"])
        parts = lengths.select("book_id", "n", F.concat(F.lit(f"{target}/"), "book_id", F.lit("/"), F.lpad(F.col("n").cast("string"), 3, "0"), F.lit(".wav")).alias("path"))
        kind = self.settings.get("publish", {}).get("format", "m4a")
        shelf.codec_arguments(kind)
        self.write("playlists", timeline.playlist(entries.withColumn("secs", F.col("ms") / 1000), about, kind))
        self.write("markers", timeline.markers(placed).join(shelf.concat_listing(parts), "book_id"))
        self.write("tags", shelf.tag_rows(entries, about))
        for r in self.read("sound").toLocalIterator():  # one chapter at a time, to local files
            place = Path(target, r["book_id"])
            place.mkdir(parents=True, exist_ok=True)
            shelf.write_wav(place / f"{r['n']:03}.wav", r["samples"], r["rate"])

    def publish(self) -> None:
        target = self.settings.get("publish", {}).get("dest", "")
        for r in self.read("books").toLocalIterator():
            shelf.publish(f"{self.folder}/books/{r['book_id']}", target, r["author"] or "", f"{r['title'] or r['book_id']} (Full Cast)")

    # ---- beside the stages ----

    def names(self, path: str) -> None:
        options = json.loads(Path(path).read_text("utf-8"))
        rows = [(b, n, v) for b, names in options.items() for n, v in names.items()]
        self.write("name_report", sound.score_names(self.spark.createDataFrame(rows, "book_id string, name string, variants array<string>"), self.speech))

    def score(self, gold: str, profiles: Sequence[str]) -> None:
        makers = {p: providers.from_settings(files.load_settings(self.options.settings, self.options.local, p)) if self.options.settings else self.make for p in profiles}
        known = self.spark.read.parquet(gold)
        script = segmentation.segments(self.chosen(self.read("chapters")), ["book_id", "n"])
        self.write("scores", scoring.score_profiles(script, known, self.members(), makers))

    def run(self) -> None:
        manifest = Path(self.folder, "manifest.json")
        state = json.loads(manifest.read_text()) if manifest.exists() else {}
        stages = [(s, KINDS.get(s)) for s in incremental.STAGES]
        shell = lambda key: subprocess.run(self.settings[key], shell=True, check=True)
        server = ((lambda: shell("server_stop")), (lambda: shell("server_start"))) if self.settings.get("server_stop") else None
        o = self.options

        def act(stage: str) -> None:
            getattr(self, stage)()

        try:
            incremental.run_stages(
                stages, act, state, only=o.only, start=o.start, until=o.until, chapters=o.chapters, force=o.force, server=server, profile=self.settings.get("profile"),
            )
        finally:
            manifest.write_text(json.dumps(state, indent=1))


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="folioloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("command", choices=["run", "fetch", "names", "score", *incremental.STAGES])
    out.add_argument("folder", nargs="?")
    out.add_argument("rest", nargs="*")
    out.add_argument("--epubs")
    out.add_argument("--settings")
    out.add_argument("--local")
    out.add_argument("--profile")
    out.add_argument("--step", choices=["all", "collect", "dedupe", "personas"], default="all", help="part of the stage cast")
    out.add_argument("--from", dest="start", choices=incremental.STAGES)
    out.add_argument("--until", choices=incremental.STAGES)
    out.add_argument("--only", nargs="*", choices=incremental.STAGES)
    out.add_argument("--chapters", nargs="*", type=int, default=[])
    out.add_argument("--force", action="store_true")
    return out


def main(given: Sequence[str] | None = None, spark: SparkSession | None = None, make: Callable[[], providers.Provider] | None = None, download: Callable[[str], str] | None = None) -> None:
    options = arguments().parse_args(given)
    if options.command == "fetch":
        if download is None:
            raise SystemExit("fetch needs a function that downloads models; call main(..., download=...)")
        print(json.dumps(shelf.fetch(files.load_settings(options.settings, options.local, options.profile), download)))
        return
    if not options.folder:
        raise SystemExit("a folder is needed")
    place = Shelf(spark or SparkSession.builder.getOrCreate(), options.folder, options, make)
    if options.command == "names":
        place.names(options.rest[0])
    elif options.command == "score":
        place.score(options.rest[0], options.rest[1:] or ["rule"])
    else:
        getattr(place, options.command)()


if __name__ == "__main__":
    main()
