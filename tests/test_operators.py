"""Operators against small independent versions, and their invariants."""

import io
import itertools
import random
import time
import tarfile
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import planes
from lamina.operators import centerline, geometry, graph, maskset, packets, projection, rank, resample, sections, temporal, tiles, topology, tracks, vote
from lamina.operators.joins import bucketed_range_join, lookup_join
from lamina.session import stored
from lamina.sources import adapters, volumes
from lamina.streaming import state


def flood(volume, connectivity):
    """Component sizes by breadth-first search."""
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    steps = [s for s in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, s)) <= most]
    left, sizes = set(map(tuple, np.argwhere(volume).tolist())), []
    while left:
        queue, size = deque([left.pop()]), 0
        while queue:
            at = queue.popleft()
            size += 1
            for s in steps:
                near = tuple(a + b for a, b in zip(at, s))
                if near in left:
                    left.remove(near)
                    queue.append(near)
        sizes.append(size)
    return sorted(sizes)


def voxel_table(spark, volume):
    return spark.createDataFrame([tuple(map(int, v)) for v in np.argwhere(volume)], "t int, y int, x int")


@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_components_match_a_flood(spark, connectivity):
    volume = np.random.default_rng(connectivity).random((5, 9, 8)) < 0.25
    labelled = topology.label(voxel_table(spark, volume), connectivity)
    assert sorted(r.size for r in topology.component_sizes(labelled).collect()) == flood(volume, connectivity)


def test_run_labels_match_voxel_labels(spark):
    volume = np.random.default_rng(2).random((4, 8, 9)) < 0.5
    mask = voxel_table(spark, volume)
    by_run = maskset.voxels(topology.label_runs(maskset.runs(mask)))
    sizes = sorted(r.n for r in by_run.groupBy("label").agg(F.count("*").alias("n")).collect())
    assert sizes == flood(volume, 6)


def test_voids_are_filled(spark):
    volume = np.random.default_rng(4).random((5, 7, 7)) < 0.7
    filled = topology.fill_voids(voxel_table(spark, volume))
    outside, queue = np.zeros(volume.shape, bool), deque()
    for at in np.argwhere(~volume):
        if any(v in (0, s - 1) for v, s in zip(at, volume.shape)):
            outside[tuple(at)] = True
            queue.append(tuple(at))
    while queue:
        at = queue.popleft()
        for axis, step in itertools.product(range(3), (-1, 1)):
            near = list(at)
            near[axis] += step
            if 0 <= near[axis] < volume.shape[axis] and not volume[tuple(near)] and not outside[tuple(near)]:
                outside[tuple(near)] = True
                queue.append(tuple(near))
    assert {(r.t, r.y, r.x) for r in filled.collect()} == set(map(tuple, np.argwhere(~outside).tolist()))


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = graph.connected_components(chain).collect()
    assert len(found) == 301 and {r.component for r in found} == {0}
    assert graph.connected_components(chain.limit(0)).count() == 0


def test_vote_does_not_depend_on_order_or_copies(spark, data):
    evidence = adapters.evidence(spark, data)
    once = vote.weighted_vote(evidence)
    again = vote.weighted_vote(evidence.union(evidence).orderBy(F.rand(1)))
    assert once.exceptAll(again).count() == again.exceptAll(once).count() == 0
    split = vote.weighted_vote(evidence.where("t < 8")).union(vote.weighted_vote(evidence.where("t >= 8")))
    assert once.exceptAll(split).count() == 0
    assert vote.weighted_vote(evidence.limit(0)).count() == 0


def test_fractions_are_nested(spark, data):
    candidates = adapters.candidates(spark, data)
    sizes = []
    before = None
    for fraction in (0.0, 0.1, 0.4, 1):
        ids = {r.identity for r in rank.fraction_sample(candidates, "identity", fraction).collect()}
        assert before is None or before <= ids
        before = ids
        sizes.append(len(ids))
    assert sizes[0] == 0 and sizes[-1] == candidates.count()


def test_json_text_escapes(spark):
    import json

    texts = ["a", 'q"uote', "back\\slash", "nul\x00end"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", rank.json_text(F.col("t")).alias("j"))
    assert {r.t: r.j for r in df.collect()} == {t: json.dumps(t, ensure_ascii=False) for t in texts}


def test_ordered_layers_reject_a_leading_subtract(spark, data):
    operations = spark.createDataFrame([("L1", 1, "subtract"), ("L2", 2, "union")], "layer_id string, ord int, op string")
    with pytest.raises(Exception, match="subtract before any union"):
        maskset.recompose(adapters.evidence(spark, data), operations).count()


def test_every_frame_of_a_domain_is_owned_once(spark, data):
    windows = temporal.domain_windows(temporal.anchor_domains(adapters.anchors(spark, data), 0, adapters.HOURS))
    owned = windows.select("lineage", F.explode(F.sequence("own_lo", F.col("own_hi") - 1)).alias("f")).groupBy("lineage").agg(
        F.count("*").alias("n"), F.count_distinct("f").alias("d")
    )
    assert owned.where(f"n <> {adapters.HOURS} OR d <> {adapters.HOURS}").count() == 0
    assert windows.where("hi - lo > 30 OR lo < 0").count() == 0


def test_joins_match_plain_ones(spark):
    rng = random.Random(1)
    left = spark.createDataFrame([(k % 3, rng.randrange(500)) for k in range(200)], "k int, p int")
    right = spark.createDataFrame([(k % 3, a, a + rng.randrange(90)) for k, a in enumerate(rng.sample(range(500), 60))], "k int, lo int, hi int")
    plain = left.join(right, "k").where("p >= lo AND p < hi")
    assert bucketed_range_join(left, right, "p", "lo", "hi", 16, ["k"]).select(plain.columns).exceptAll(plain).count() == 0
    assert bucketed_range_join(left, right, "p", "lo", "hi", 16, ["k"]).count() == plain.count()
    keys = left.groupBy("k").agg(F.count("*").alias("rows"))
    assert lookup_join(left, keys, "k", "rows", 200, hot_share=0.34).count() == 200


def test_plane_kernels_match_plain_ones():
    rng = np.random.default_rng(0)
    for _ in range(8):
        plane = rng.random((12, 13)) < 0.55
        for diagonal, connectivity in ((False, 6), (True, 26)):
            parts = planes.parts_2d(plane, diagonal)
            assert sorted(np.bincount(parts.ravel())[1:].tolist()) == flood(plane[None], connectivity)
        empty = np.argwhere(~plane)
        depth = planes.distance_to_background(plane)
        for y, x in np.argwhere(plane):
            assert depth[y, x] == pytest.approx(np.sqrt(((empty - (y, x)) ** 2).sum(1).min()))
        area = sum(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2 for p in planes.outline(plane))
        assert area == plane.sum()
        filled = planes.fill_holes(plane)
        outside = np.pad(~filled, 1, constant_values=True)
        assert planes.parts_2d(outside, False).max() == 1 and (filled | ~plane).all() and (planes.fill_holes(filled) == filled).all()
    block = np.zeros((20, 20), bool)
    block[4:12, 5:15] = True
    assert (planes.rasterize(planes.outline(block)[0], 20, 20) == block).all()
    assert (planes.opened(block) <= block).all() and planes.keep_thick_parts(block, 3).sum() == 80 and planes.keep_thick_parts(block, 9).sum() == 0
    clipped = planes.clip_to_box([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], (5.0, 5.0, 20.0, 20.0))
    assert abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(clipped, clipped[1:] + clipped[:1]))) / 2 == 25


def test_assignment_is_the_best_of_all_permutations():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 6):
        score = rng.random((n, n)).round(2)
        chosen = tracks.best_assignment(score)
        assert sorted(chosen) == list(range(n))
        best = max(sum(score[k, p[k]] for k in range(n)) for p in itertools.permutations(range(n)))
        assert score[np.arange(n), chosen].sum() == pytest.approx(best)


def test_pooling_covers_every_source_voxel(spark):
    volume = np.random.default_rng(8).random((6, 9, 10)) < 0.1
    found = {(r.t, r.y, r.x) for r in resample.restore_or(voxel_table(spark, volume), (6, 9, 10), (4, 5, 3)).collect()}
    want = set()
    cells = [(s, d) for s, d in zip((6, 9, 10), (4, 5, 3))]
    for at in itertools.product(range(4), range(5), range(3)):
        box = tuple(slice(i * s // d, ((i + 1) * s + d - 1) // d) for i, (s, d) in zip(at, cells))
        if volume[box].any():
            want.add(at)
    assert found == want


def test_nrrd_round_trip(spark, tmp_path):
    volume = np.random.default_rng(1).random((3, 5, 6)) < 0.4
    layer = voxel_table(spark, volume).withColumn("layer_id", F.lit("L"))
    content = volumes.encode_nrrd(layer, volume.shape).first().content
    (tmp_path / "a.nrrd").write_bytes(bytes(content))
    back = maskset.voxels(volumes.read_nrrd_runs(spark, str(tmp_path))).select("t", "y", "x")
    assert {(r.t, r.y, r.x) for r in back.collect()} == set(map(tuple, np.argwhere(volume).tolist()))


def test_packed_rows_round_trip(spark, data):
    voxels = adapters.evidence(spark, data).select("layer_id", "t", "y", (F.col("x") * 9).alias("x"))
    back = maskset.unpack_rows(maskset.pack_rows(voxels, "layer_id")).select(voxels.columns)
    assert back.exceptAll(voxels).count() == voxels.exceptAll(back).count() == 0


def test_labels_manifests_archives_and_telemetry(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels" / "v_1.txt").write_text("0 0.1 0.1 0.5 0.1 0.5 0.5\n")
    (tmp_path / "labels" / "v_2.txt").write_text("")
    polygons = volumes.read_polygon_labels(spark, str(tmp_path / "labels")).collect()
    assert len(polygons) == 1 and [(p.x, p.y) for p in polygons[0].points] == [(0.1, 0.1), (0.5, 0.1), (0.5, 0.5)]
    frames = spark.range(1, 4).withColumnRenamed("id", "frame")
    states = volumes.annotation_states(frames, frames.where("frame = 1"), frames.where("frame < 3"))
    assert {r.frame: r.state for r in states.collect()} == {1: "foreground", 2: "known_background", 3: "unknown"}

    manifest = '{"exported_axes": "(X,Y,t)", "layers": [%s]}'
    layer = '{"filename": "%s", "layer_role": "%s", "recomposition_op": "union", "mask_kind": "yolo"}'
    (tmp_path / "m.json").write_text(manifest % ",".join([layer % ("a", "additive_component"), layer % ("b", "other")]))
    assert [r.filename for r in volumes.read_manifest_layers(spark, str(tmp_path / "m.json")).collect()] == ["a"]
    (tmp_path / "n.json").write_text(manifest % ",".join([layer % ("a", "additive_component")] * 2))
    with pytest.raises(Exception, match="listed twice"):
        volumes.read_manifest_layers(spark, str(tmp_path / "n.json")).collect()

    archive = io.BytesIO()
    with tarfile.open(fileobj=archive, mode="w") as tar:
        for name in ("x/1", "x/2", "y/1"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    (tmp_path / "a.tar").write_bytes(archive.getvalue())
    assert volumes.read_tar(spark, str(tmp_path / "a.tar"), "x/").count() == 2
    spark.dataSource.register(volumes.TarMembers)
    assert spark.read.format("tar_members").option("prefix", "x/").load(str(tmp_path / "a.tar")).where("content = X'616263'").count() == 2

    line = '{"trace_session": "s", "sequence": %d, "event": "%s", "run_id": "r", "monotonic_ns": 5}\n'
    (tmp_path / "t.jsonl").write_text(line % (1, "a") + line % (1, "a") + line % (2, "b") + '{"trace_session": "s", "seq')
    assert volumes.read_telemetry(spark, str(tmp_path / "t.jsonl")).count() == 2
    (tmp_path / "u.jsonl").write_text(line % (1, "a") + line % (1, "c"))
    with pytest.raises(Exception, match="conflicting event"):
        volumes.read_telemetry(spark, str(tmp_path / "u.jsonl")).collect()

    volumes.write_with_manifest(spark.range(5), str(tmp_path / "out"))
    assert volumes.read_complete(spark, str(tmp_path / "out")).count() == 5
    paths = spark.createDataFrame([(f"/d/vol_{k}.png",) for k in (1, 2, 4)] + [("/d/single.png",)], "path string")
    assert {r.stem: (r.frames, r.missing) for r in volumes.discover_volumes(paths).collect()} == {"vol": (3, 1), "single": (1, 0)}


def test_mailboxes_do_not_depend_on_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(2)
    offers = [(k % 3, rng.randrange(20), rng.random()) for k in range(60)]
    ends = []
    for turn in range(2):
        folder = tmp_path / str(turn)
        rng.shuffle(offers)
        for k in range(0, 60, 20):
            spark.createDataFrame(offers[k : k + 20] * (1 + turn), "tile long, source long, prob double").coalesce(1).write.mode("append").parquet(str(folder))
        found = state.run_available(state.mailbox_stream(state.file_stream(spark, str(folder), "tile long, source long, prob double")))
        last = found.groupBy("tile").agg(F.max_by(F.struct("prob", "sources"), F.struct("batch", "revision")).alias("s"))
        ends.append({r.tile: (r.s.prob, tuple(r.s.sources)) for r in last.collect()})
    assert ends[0] == ends[1] and len(ends[0]) == 3


def test_ledger_rejects_one_packet_with_two_contents(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "work_id long, sha string").coalesce(1).write.parquet(str(tmp_path / "p"))
    assert state.run_ingestion(state.file_stream(spark, str(tmp_path / "p"), "work_id long, sha string")).count() == 2
    spark.createDataFrame([(1, "other")], "work_id long, sha string").coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    with pytest.raises(Exception, match="two contents"):
        state.run_ingestion(state.file_stream(spark, str(tmp_path / "p"), "work_id long, sha string"))


def test_distances_and_displacements():
    block = np.zeros((12, 12), bool)
    block[3:9, 2:8] = True
    assert (planes.resize_by_distance(block, (12, 12)) == block).all()
    big = planes.resize_by_distance(block, (24, 24))
    assert 0.8 * 4 * block.sum() <= big.sum() <= 1.2 * 4 * block.sum() and big[12, 10] and not big[0].any()
    dy, dx = np.full((12, 12), 2.0), np.full((12, 12), -1.0)
    assert (planes.undo_displacement(block, dy, dx)[5:11, 1:7]).all() and planes.undo_displacement(block, dy, dx).sum() == block.sum()
    two = block.copy()
    two[11, 11] = True
    two[5, 4] = False
    assert (planes.center_part(two) == block).all()


def test_tags_are_unique_and_do_not_depend_on_order(spark):
    ids = spark.range(100).withColumnRenamed("id", "doc_id")
    tags = [{r.identity: r.tag for r in rank.unique_tags(df, "doc_id", 2).collect()} for df in (ids, ids.orderBy(F.desc("doc_id")).repartition(3))]
    assert tags[0] == tags[1] and len(set(tags[0].values())) == 100
    assert rank.unique_tags(ids.limit(0), "doc_id", 2).count() == 0


def labelled_parts(spark, volume):
    mask = voxel_table(spark, volume)
    parts = topology.slice_components(mask).join(topology.label(mask), ["t", "y", "x"]).cache()
    return parts, parts.join(topology.endpoints(parts).select("part", "side"), "part")


def test_bridges_join_two_blocks(spark):
    volume = np.zeros((5, 10, 10), bool)
    volume[0, 2:6, 2:6] = volume[4, 2:6, 3:7] = True
    parts, ends = labelled_parts(spark, volume)
    painted = {(r.t, r.y, r.x) for r in geometry.bridge_sections(parts, ends, (10, 10), 4, 1.0).collect()}
    assert {t for t, _, _ in painted} == {1, 2, 3} and all((t, y, x) in painted for t in (1, 2, 3) for y in range(2, 6) for x in range(3, 6))
    # the boxes of the kernel give what whole planes give
    a, b = (planes.signed_distance(volume[t]) for t in (0, 4))
    want = {(t, int(y), int(x)) for t in (1, 2, 3) for y, x in np.argwhere(planes.center_part((a * (4 - t) + b * t) / 4 >= 0))}
    assert painted == want
    assert geometry.bridge_sections(parts, ends, (10, 10), 3, 1.0).count() == 0


@pytest.mark.parametrize("wrap", [None, (7, 30)])
def test_endpoint_candidates_match_a_search_of_all_pixels(spark, wrap):
    rng = np.random.default_rng(8)
    volume = np.zeros((7, 26, 30), bool)
    for _ in range(16):
        t, y, x = rng.integers(0, (7, 22, 26))
        volume[t, y : y + rng.integers(1, 6), x : x + rng.integers(1, 6)] = True
    parts, ends = labelled_parts(spark, volume)
    slope, steps, most = 2.5, 3, 2
    found = {(r.part, r.side, r.target, r.step, r.t, r.y, r.x, r.d2, r.place) for r in geometry.endpoint_candidates(ends, parts, steps, slope, most, wrap).collect()}
    label = {(r.t, r.y, r.x): r.label for r in parts.collect()}
    sections = {}
    for r in ends.collect():
        sections.setdefault((r.part, r.side, r.label, r.t), []).append((r.y, r.x))
    want = set()
    for (part, side, own, t), cells in sections.items():
        my, mx = np.mean(cells, 0)
        ay, ax = min(cells, key=lambda c: (round((c[0] - my) ** 2 + (c[1] - mx) ** 2, 9), c))
        seen = {}
        for step in range(1, steps + 1):
            at, mirrored = t + side * step, False
            if wrap is not None:
                at, mirrored = at % 7, not 0 <= at < 7
            here = {}
            for (vt, vy, vx), target in label.items():
                ux = 29 - vx if mirrored else vx
                if vt == at and target != own and target not in seen and min((vy - y) ** 2 + (ux - x) ** 2 for y, x in cells) <= (slope * step) ** 2 + 1e-9:
                    here.setdefault(target, []).append(((vy - ay) ** 2 + (ux - ax) ** 2, vy, ux, vx))
            for target, options in here.items():
                d2, y, _, x = min(options)
                seen[target] = (step, d2, target, at, y, x)
        for place, (step, d2, target, at, y, x) in enumerate(sorted(seen.values())[:most], 1):
            want.add((part, side, target, step, at, y, x, d2, place))
    assert found == want and len(want) > 10


def test_distances_are_exact_and_quick_whatever_the_plane_holds():
    import time

    rng = np.random.default_rng(6)
    for shape in ((1, 1), (1, 9), (9, 1), (17, 23)):
        for share in (0.0, 0.3, 0.9, 0.98, 1.0):
            plane = rng.random(shape) < share
            bare = np.argwhere(~plane)
            want = [[(np.hypot(*(bare - (y, x)).T).min() if len(bare) else sum(shape)) if plane[y, x] else 0 for x in range(shape[1])] for y in range(shape[0])]
            assert np.allclose(planes.distance_to_background(plane), want)
    for holes in ([(0, 0)], [(1500, 3)], [tuple(p) for p in rng.integers(0, 3072, (40, 2))]):
        plane = np.ones((3072, 3072), bool)
        plane[tuple(np.transpose(holes))] = False
        began = time.perf_counter()
        depth = planes.distance_to_background(plane)
        assert time.perf_counter() - began < 30
        for y, x in rng.integers(0, 3072, (50, 2)):
            assert depth[y, x] == pytest.approx(min(np.hypot(y - a, x - b) for a, b in holes))


@pytest.mark.parametrize("connectivity", [6, 18, 26, 4])
def test_gaps_are_filled_as_a_flood_from_outside_leaves_them(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    volume = rng.random((7, 8, 9)) < (0.62 if connectivity in (4, 6) else 0.9)
    most = {6: 1, 18: 2, 26: 3, 4: 1}[connectivity]
    steps = [s for s in itertools.product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, s)) <= most and (connectivity != 4 or s[0] == 0)]
    shift = (0, 1, 1) if connectivity == 4 else (1, 1, 1)
    empty = np.pad(~volume, [(k, k) for k in shift], constant_values=True)
    border = lambda at: any(c in (0, n - 1) for c, n, k in zip(at, empty.shape, shift) if k)
    queue = deque(at for at in map(tuple, np.argwhere(empty)) if border(at))
    outside = set(queue)
    while queue:
        at = queue.popleft()
        for s in steps:
            near = tuple(a + b for a, b in zip(at, s))
            if all(0 <= c < n for c, n in zip(near, empty.shape)) and empty[near] and near not in outside:
                outside.add(near)
                queue.append(near)
    want = {tuple(int(a - b) for a, b in zip(at, shift)) for at in np.ndindex(*empty.shape) if at not in outside}
    inside = {at for at in want if all(0 <= c < n for c, n in zip(at, volume.shape))}
    found = {(r.t, r.y, r.x) for r in topology.fill_voids(voxel_table(spark, volume), connectivity).collect()}
    assert found == inside and len(found) > volume.sum()


def test_cleanup_fills_holes_last(spark):
    plane = np.zeros((1, 14, 14), bool)
    plane[0, 1:8, 1:8] = True
    plane[0, 3:6, 3:6] = False  # a ring: filled it would be thick, as it is its radius is 1.41
    plane[0, 10:13, 10:13] = True  # a block of radius 2 with a weak score
    mask = voxel_table(spark, plane)
    scores = spark.createDataFrame([(0, 1, 1, 240), (0, 11, 11, 100)], "t int, y int, x int, score int")
    ring, block = plane.copy(), plane.copy()
    ring[0, 10:], block[0, :9] = False, False
    full = ring.copy()
    full[0, 3:6, 3:6] = True
    cells = lambda v: {tuple(map(int, p)) for p in np.argwhere(v)}
    clean = lambda **gates: {(r.t, r.y, r.x) for r in topology.clean_planes(mask, scores, (14, 14), **gates).collect()}
    assert clean(min_score=200) == cells(full)
    assert clean(min_radius=2.0) == cells(block)
    assert clean(min_score=200, min_radius=2.0) == set()
    assert clean() == cells(full | block)
    # holes filled first, the ring would have stayed
    filled = topology.fill_holes(mask)
    assert {(r.t, r.y, r.x) for r in topology.clean_planes(filled, scores, (14, 14), min_score=200, min_radius=2.0).collect()} == cells(full)


def test_edges_with_numbers_and_planes_beyond_any_shift(spark):
    # the number of an edge must not reach into the planes of another
    support = spark.createDataFrame([(e, t, 0, 0) for e in (0, 4096, 2**40) for t in (0, 1, 1023)] + [(7, 1022, 5, 5), (7, 1023, 5, 5)], "edge long, t int, y int, x int")
    ends = spark.createDataFrame([(e, k, t, 0, 0) for e in (0, 4096, 2**40) for k, t in ((0, 0), (1, 1023))] + [(7, 0, 1022, 5, 5), (7, 1, 1023, 5, 5)], "edge long, end int, t int, y int, x int")
    assert [r.edge for r in geometry.connected_edges(support, ends).collect()] == [7]


def test_caps_keep_the_background_of_a_null_subset(spark):
    rows = [(sub, f"{sub}-{k}", k, k < 30, f"s{k % 3}") for sub in ("a", None) for k in range(40)]
    df = spark.createDataFrame(rows, "subset string, identity string, ord int, fg boolean, source string")
    for kept in (rank.background_cap(df, "subset"), rank.breadth_first_cap(df, "source", "subset"), rank.final_cap(df.withColumn("version", F.lit(0)), "source", "subset")):
        assert {(r.subset, r.fg): r["count"] for r in kept.groupBy("subset", "fg").count().collect()} == {(s, f): n for s in ("a", None) for f, n in ((True, 30), (False, 10))}


def test_final_cap_takes_originals_then_copies_breadth_first(spark):
    rows = [("t", f"i{k}", k, True, 0) for k in range(21)]  # seven of background are allowed
    rows += [("t", f"b{k}", 100 + k, False, 0) for k in range(3)]
    rows += [("t", f"c{k}", 200 + k, False, v) for k in range(3) for v in (1, 2, 3)]
    df = spark.createDataFrame(rows, "subset string, identity string, ord int, fg boolean, version int")
    kept = [(r.identity, r.version) for r in rank.final_cap(df, "identity", "subset").where("NOT fg").collect()]
    assert len(kept) == 7 and {i for i, v in kept if v == 0} == {"b0", "b1", "b2"}
    copies = [i for i, v in kept if v]
    assert len(copies) == 4 and set(copies) == {"c0", "c1", "c2"}
    few = df.where("fg = false OR ord < 6")  # two allowed: originals only
    assert {v for _, v in [(r.identity, r.version) for r in rank.final_cap(few, "identity", "subset").where("NOT fg").collect()]} == {0}


def test_versions_are_for_the_training_part_only(spark):
    df = spark.createDataFrame([(f"i{k}", k % 2 == 0, k < 7) for k in range(10)], "identity string, fg boolean, train boolean")
    counted = {r.identity: r.copies for r in rank.version_counts(df, (5, 2), F.col("train")).collect()}
    assert sum(counted.values()) == 18 - 7 and all(counted[f"i{k}"] == 0 for k in range(7, 10))  # floor(17.5 + 1/2) versions in all
    # of the remainder of four the foreground comes first
    assert [counted[f"i{k}"] for k in (0, 2, 4, 6)] == [2] * 4


def test_sections_of_a_bent_line_match_numpy(spark):
    angles = np.linspace(0, 0.8 * np.pi, 33)
    path = np.column_stack((12 + 9 * np.cos(angles), 13 + 9 * np.sin(angles), 10 + angles))
    path = np.insert(path, 5, path[4], 0)  # a repeated point
    volume = np.random.default_rng(0).integers(0, 256, (26, 25, 20)) * (np.random.default_rng(1).random((26, 25, 20)) < 0.6)
    points = spark.createDataFrame([(3, k, *map(float, p)) for k, p in enumerate(path)] + [(4, 0, 1.0, 1.0, 1.0), (4, 1, 1.0, 1.0, 1.0)], "branch long, ord int, t double, y double, x double")
    frames = geometry.transport_frames(geometry.centerline_samples(points)).orderBy("branch", "s").toPandas()
    assert set(frames.branch) == {3}  # one place is no line
    at, u, v = (frames[[f"{n}{c}" for c in "tyx"]].to_numpy() for n in ("", "u_", "v_"))
    arc = np.r_[0, np.cumsum(np.linalg.norm(np.diff(path, axis=0), axis=1))]
    where = np.linspace(0, arc[-1], round(arc[-1]) + 1)
    assert np.allclose(at, np.column_stack([np.interp(where, arc, path[:, k]) for k in range(3)]))
    along = np.gradient(at, axis=0)
    along /= np.linalg.norm(along, axis=1, keepdims=True)
    for a, b in ((u, v), (u, along), (v, along)):
        assert np.allclose((a * b).sum(1), 0, atol=1e-9)
    assert np.allclose(np.linalg.norm(u, axis=1), 1) and (u[1:] * u[:-1]).sum(1).min() > 0.9 and np.allclose(np.cross(along, u), v)
    voxels = spark.createDataFrame([(*map(int, p), int(volume[tuple(p)])) for p in np.argwhere(volume)], "t int, y int, x int, value int")
    drawn = spark.createDataFrame(frames)
    size, center = 7, 3
    mixed, nearest = np.zeros((2, len(at), size, size), int)
    value = lambda p: volume[tuple(p)] if all(0 <= c < n for c, n in zip(p, volume.shape)) else 0
    for s, row, col in np.ndindex(len(at), size, size):
        p = np.round(at[s] + (col - center) * u[s] + (row - center) * v[s], 9)
        low = np.floor(p).astype(int)
        total = sum(value(low + d) * np.prod(np.where(d, p - low, 1 - p + low)) for d in map(np.array, itertools.product((0, 1), repeat=3)))
        mixed[s, row, col] = np.clip(np.rint(round(total, 6)), 0, 255)
        nearest[s, row, col] = value(np.floor(p + 0.5).astype(int))
    for categorical, want in ((False, mixed), (True, nearest)):
        found = np.zeros_like(want)
        for r in geometry.section_raster(drawn, voxels, size, categorical).collect():
            found[r.s, r.row, r.col] = r.value
        assert (found == want).all()


def test_equal_area_cube_covers_each_face_evenly(spark):
    from lamina.operators import geometry

    rng = np.random.default_rng(0)
    points = rng.normal(size=(6000, 3))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    df = spark.createDataFrame(points.tolist(), "x double, y double, z double")
    rows = geometry.qsc_forward(df).select(F.col("face").alias("f"), "u", "v").collect()
    assert all(abs(r.u) <= 1 + 1e-9 and abs(r.v) <= 1 + 1e-9 for r in rows)
    counts = np.zeros((6, 2, 2))
    for r in rows:
        counts[r.f, int(r.u >= 0), int(r.v >= 0)] += 1
    assert counts.min() > 180 and counts.max() < 330
    inner = sum(max(abs(r.u), abs(r.v)) <= 0.5 for r in rows) / len(rows)
    assert abs(inner - 0.25) < 0.03


def test_edges_need_one_component_with_both_ends(spark):
    from lamina.operators import geometry

    line = [(1, 0, 0, x) for x in range(5)] + [(2, 0, 0, x) for x in (0, 1, 3, 4)] + [(3, 0, y, y) for y in range(4)]
    support = spark.createDataFrame(line, "edge int, t int, y int, x int")
    ends = spark.createDataFrame([(1, 0, 0, 0, 0), (1, 1, 0, 0, 4), (2, 0, 0, 0, 0), (2, 1, 0, 0, 4), (3, 0, 0, 0, 0), (3, 1, 0, 3, 3)], "edge int, end int, t int, y int, x int")
    assert {r.edge for r in geometry.connected_edges(support, ends).collect()} == {1, 3}
    assert {r.edge for r in geometry.connected_edges(support, ends, 6).collect()} == {1}


def test_crops_merge_the_smallest_pair_that_fits(spark):
    from lamina.operators import geometry

    boxes = [(0, 1, 0, 2, 0, 2), (0, 2, 1, 3, 1, 3), (0, 3, 8, 9, 8, 9), (0, 4, 0, 2, 4, 6), (1, 9, 0, 5, 0, 5)]
    df = spark.createDataFrame(boxes, "frame int, obj long, y0 int, y1 int, x0 int, x1 int")
    found = geometry.dynamic_crops(df, 6, 3).collect()
    crops = {}
    for r in found:
        crops.setdefault((r.frame, r.crop, r.y0, r.y1, r.x0, r.x1), set()).add(r.obj)
    assert sorted((k[0], *k[2:], sorted(v)) for k, v in crops.items()) == [(0, 0, 3, 0, 6, [1, 2, 4]), (0, 8, 9, 8, 9, [3]), (1, 0, 5, 0, 5, [9])]


def test_tile_numbers_are_unique_in_wide_grids(spark):
    grid = tiles.tile_grid(spark.createDataFrame([(24, 12_000)], "height int, width int"), 8, 8)
    assert grid.count() == grid.select("tile").distinct().count() == 3 * 1500


def test_edges_stay_apart_however_many_planes(spark):
    # edge 0 ends at plane 1023, edge 1 begins at plane 0: neither may borrow voxels of the other
    support = spark.createDataFrame([(0, 1023, 0, 0), (0, 1022, 5, 5), (1, 0, 0, 0), (1, 1, 0, 0)], "edge int, t int, y int, x int")
    ends = spark.createDataFrame([(0, 0, 1023, 0, 0), (0, 1, 1022, 5, 5), (1, 0, 0, 0, 0), (1, 1, 1, 0, 0)], "edge int, end int, t int, y int, x int")
    assert [r.edge for r in geometry.connected_edges(support, ends).collect()] == [1]


def test_distance_of_a_large_plane_needs_little_memory():
    import tracemalloc

    plane = np.zeros((2048, 2048), bool)
    plane[500:900, 300:1800] = True
    tracemalloc.start()
    depth = planes.distance_to_background(plane)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 500e6 and depth.max() == 200 and depth[500, 1000] == 1 and depth[0, 0] == 0
    assert planes.distance_to_background(np.ones((3, 4), bool)).min() == 7


def test_too_many_views_are_an_error(spark):
    with pytest.raises(ValueError, match="views"):
        tracks.longest_first(spark.range(5).selectExpr("cast(id AS string) AS view", "id AS cost"), 2, most=4)


def test_section_codes_of_known_orientations(spark):
    normals = [(0, 0, 1), (0, 0, -2), (1, 0, 0), (-1, 0, 0), (0, 3, 0), (1, 1, 0), (-1, -1, 0), (1, 0, 1), (-1, 0, 1), (1, 0, -1), (0, 0, 0), (None, 0, 1)]
    df = spark.createDataFrame([(k, *[None if v is None else float(v) for v in n]) for k, n in enumerate(normals)], "k int, x double, y double, t double")
    code = {r.k: r.code for r in df.select("k", sections.plane_code(F.col("x"), F.col("y"), F.col("t")).alias("code")).collect()}
    first = sections.PLANE + 1
    up = [(90, 0), (90, 0), (0, 0), (0, 0), (0, 90), (0, 45), (0, 45), (45, 0), (45, 180), (45, 180)]
    assert [code[k] for k in range(10)] == [first + 360 * e + a for e, a in up]
    assert code[10] is None and code[11] is None
    row = spark.range(1).select(
        sections.plane_code(*sections.tilted_normal("coronal", 30, "vertical")).alias("tilted"),
        sections.cylinder_code("coronal").alias("cylinder"),
        sections.sphere_code().alias("sphere"),
        sections.unknown_code(F.lit("unknown:a")).alias("unknown"),
    ).first()
    # The stack axis of the coronal view is x, its vertical one t: the normal is (1, 0, -tan 30), or (-1, 0, tan 30) with t positive.
    assert row.tilted == first + 360 * 30 + 180
    assert (row.cylinder, row.sphere) == (sections.CYLINDER + 2, sections.SPHERE) and row.unknown >= sections.UNKNOWN
    with pytest.raises(ValueError):
        sections.plane_code(F.lit(1.0), F.lit(0.0), F.lit(0.0), 0)


def test_azimuths_are_the_nearest_recorded_ones(spark):
    recorded = (10, 75.5, 140, 321)
    places = [(u, v) for u in range(-4, 5) for v in range(-4, 5) if u or v]
    df = spark.createDataFrame([(float(u), float(v)) for u, v in places], "u double, v double")
    apart = lambda a, b: min((a - b) % 180, (b - a) % 180)
    for r in df.select("u", "v", sections.nearest_azimuth(F.col("u"), F.col("v"), recorded).alias("a")).collect():
        angle = np.degrees(np.arctan2(r.v, r.u))
        assert abs(apart(angle, r.a) - min(apart(angle, a) for a in recorded)) < 1e-9
    tie = spark.range(1).select(sections.nearest_azimuth(F.lit(0.0), F.lit(1.0), (45, 135)).alias("a")).first().a
    assert tie == 45


def test_tracklet_metrics_match_dense_masks(spark):
    rng = np.random.default_rng(5)
    shape = (6, 7)
    masks = {}
    for side in "ab":
        for obj in range(4):
            for frame in sorted(rng.choice(7, 5, replace=False)):
                masks[side, obj, int(frame)] = (rng.random(shape) < rng.choice([0, 0.2, 0.6]), float(rng.choice([0.2, 0.5, 0.9])))
    frame_rows = lambda side: spark.createDataFrame([(o, f, p) for (s, o, f), (_, p) in masks.items() if s == side], "obj int, frame int, p double")
    voxels = lambda side: spark.createDataFrame([(o, f, int(y), int(x)) for (s, o, f), (m, _) in masks.items() if s == side for y, x in np.argwhere(m)], "obj int, frame int, y int, x int")
    found = tracks.overlap_metrics(voxels("a"), voxels("b"), frame_rows("a"), frame_rows("b"), float(np.hypot(*shape)))
    rows = {(r.a, r.b): r for r in found.select("*", tracks.gate_failures().alias("failed"), tracks.similarity().alias("score")).collect()}
    seen = 0
    for a, b in itertools.product(range(4), range(4)):
        shared = [f for f in range(7) if ("a", a, f) in masks and ("b", b, f) in masks]
        pairs = [(*masks["a", a, f], *masks["b", b, f]) for f in shared]
        common = sum(int((l & r).sum()) for l, _, r, _ in pairs)
        if not common:
            assert (a, b) not in rows
            continue
        seen += 1
        r = rows[a, b]
        useful = [q for q in pairs if (q[0] | q[2]).any()]
        active = [q for q in useful if q[0].any() and q[2].any()]
        ious = [(q[0] & q[2]).sum() / (q[0] | q[2]).sum() for q in useful]
        apart = [np.linalg.norm(np.argwhere(q[0]).mean(0) - np.argwhere(q[2]).mean(0)) / np.hypot(*shape) for q in active]
        drift = [abs(np.log(q[0].sum() / q[2].sum())) for q in active]
        joint = [np.sqrt(q[1] * q[3]) for q in useful]
        every = sum(int((q[0] | q[2]).sum()) for q in pairs)
        assert (r.frames, r.useful, r.coactive, r.intersection, r.union_voxels) == (len(shared), len(useful), len(active), common, every)
        want = [len(active) / len(useful), common / every, np.mean(ious), *np.percentile(ious, (50, 10)), min(ious), max(ious), np.mean(apart), *np.percentile(apart, (50, 95)), np.mean(drift), *np.percentile(drift, (50, 95)), np.mean(joint), min(joint)]
        got = [r.coverage, r.iou, r.iou_mean, r.iou_median, r.iou_p10, r.iou_min, r.iou_max, r.apart_mean, r.apart_median, r.apart_p95, r.drift_mean, r.drift_median, r.drift_p95, r.joint_mean, r.joint_min]
        assert np.allclose(got, want)
        checks = [len(shared) >= 3, len(useful) >= 3, len(active) >= 3, r.iou >= 0.2, r.iou_median >= 0.15, r.coverage >= 0.5, r.apart_median <= 0.15, r.drift_median <= np.log(4), r.joint_mean >= 0.5]
        assert list(r.failed) == [g[0] for g, fine in zip(tracks.GATES, checks) if not fine]
        terms = [r.iou, r.dice, r.iou_median, r.coverage, np.exp(-4 * r.apart_median), np.exp(-r.drift_median), r.joint_mean]
        assert np.isclose(r.score, np.dot(terms, [0.3, 0.1, 0.15, 0.15, 0.1, 0.05, 0.15]))
    assert seen > 3


def pull(shape, address, view):
    """(t, y, x) -> the greatest score of the cells that each voxel looks at, voxel by voxel."""
    found = {}
    for at in itertools.product(*map(range, shape)):
        scores = [view[c] for c in address(*at) if c in view]
        if scores:
            found[at] = max(scores)
    return found


def half_up(v):
    return int(np.floor(round(v, 9) + 0.5))


def seen_by(axis_work, axis_out, at):
    """Coordinates of a target place: the cells it meets, or its center."""
    if axis_out < axis_work:
        return range(at * axis_work // axis_out, -(-(at + 1) * axis_work // axis_out))
    return [(at + 0.5) * axis_work / axis_out - 0.5]


@pytest.mark.parametrize(("work", "out", "along", "slope"), [((9, 8, 7), (9, 8, 7), "x", 0.37), ((9, 8, 7), (5, 13, 3), "y", -0.8), ((6, 5, 9), (11, 3, 14), "x", 1.3)])
def test_tilted_push_equals_the_pull(spark, work, out, along, slope):
    rng = np.random.default_rng(sum(out))
    view = {tuple(map(int, c)): int(s) for c, s in zip(np.argwhere(rng.random(work) < 0.2), rng.integers(1, 255, 10_000))}

    def address(t, y, x):
        for ct, cy, cx in itertools.product(*(seen_by(w, o, at) for w, o, at in zip(work, out, (t, y, x)))):
            off = cy - (work[1] - 1) / 2 if along == "y" else cx - (work[2] - 1) / 2
            yield half_up(ct - slope * off + 2), half_up(cy), half_up(cx)

    rows = spark.createDataFrame([(*c, s) for c, s in view.items()], "frame int, v int, u int, score int")
    found = {(r.t, r.y, r.x): r.score for r in projection.push_tilted(rows, work, out, slope, along, first=-2).collect()}
    assert found == pull(out, address, view) and found


@pytest.mark.parametrize(("work", "out"), [((5, 11, 11), (5, 11, 11)), ((6, 9, 12), (4, 14, 7))])
def test_azimuthal_and_radial_push_equal_the_pull(spark, work, out):
    rng = np.random.default_rng(4)
    offset = lambda at, w, o: (2 * at + 1 - o) * w / (2 * o)
    radius, angles, columns = (min(work[1:]) - 1) / 2, 7, 9
    view = {tuple(map(int, c)): int(s) for c, s in zip(np.argwhere(rng.random((angles, work[0], columns)) < 0.4), rng.integers(1, 255, 10_000))}

    def line(t, y, x):
        dy, dx = offset(y, work[1], out[1]), offset(x, work[2], out[2])
        if round(np.hypot(dx, dy), 9) > radius + 0.5:
            return
        theta = np.degrees(np.arctan2(dy, dx)) % 180
        angle = int(np.ceil(round(theta / (180 / angles), 9) - 0.5)) % angles
        signed = dx * np.cos(np.radians(angle * 180 / angles)) + dy * np.sin(np.radians(angle * 180 / angles))
        column = int(np.clip(np.rint(round((signed + radius) / (2 * radius) * (columns - 1), 9)), 0, columns - 1))
        for ct in seen_by(work[0], out[0], t):
            yield angle, half_up(ct), column

    rows = spark.createDataFrame([(*c, s) for c, s in view.items()], "angle int, row int, col int, score int")
    found = {(r.t, r.y, r.x): r.score for r in projection.push_azimuthal(rows, work, out, angles, columns, radius).collect()}
    assert found == pull(out, line, view) and found

    least, gap, shells, columns = 0.12, 0.9, 5, 12
    view = {tuple(map(int, c)): int(s) for c, s in zip(np.argwhere(rng.random((shells, work[0], columns)) < 0.4), rng.integers(1, 255, 10_000))}

    def shell(t, y, x):
        dy, dx = offset(y, work[1], out[1]), offset(x, work[2], out[2])
        r = np.hypot(dx, dy)
        height = offset(t, work[0], out[0]) + (work[0] - 1) / 2
        if not least <= round(r, 9) <= round(least + gap * (shells - 1), 9) or not -0.5 <= round(height, 9) < work[0] - 0.5:
            return
        k = int(np.clip(np.ceil(round((r - least) / gap, 9) - 0.5), 0, shells - 1))
        own = least + gap * k
        row = int(np.rint(round(min(max(height, 0), work[0] - 1), 9)))
        start = (np.arctan2(dy, dx) % (2 * np.pi) * own + 0.5) % (2 * np.pi * own) - 0.5
        turns = range(columns) if 2 * np.pi * own <= 1 else {int(np.rint(round(start + m * 2 * np.pi * own, 9))) for m in range(columns + 2)}
        for column in turns:
            yield k, row, column

    rows = spark.createDataFrame([(*c, s) for c, s in view.items()], "shell int, row int, col int, score int")
    found = {(r.t, r.y, r.x): r.score for r in projection.push_radial(rows, work, out, least, gap, shells, columns).collect()}
    assert found == pull(out, shell, view) and found


def test_cube_directions_go_there_and_back(spark):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(int(f), float(u), float(v)) for f, u, v in zip(rng.integers(0, 6, 400), *rng.uniform(-1, 1, (2, 400)))] + [(f, u, v) for f in range(6) for u in (-1.0, 0.0, 1.0) for v in (-1.0, 0.0, 1.0)], "face int, u double, v double")
    there = projection.qsc_direction(rows.withColumnsRenamed({"u": "u0", "v": "v0"}), "face", "u0", "v0")
    for r in geometry.qsc_on_face(there, "dx", "dy", "dz").collect():
        assert r.on_face and abs(r.dx**2 + r.dy**2 + r.dz**2 - 1) < 1e-12
        assert abs(r.u - r.u0) < 1e-6 and abs(r.v - r.v0) < 1e-6


def test_sphere_push_gives_back_what_was_sampled(spark):
    volume = np.random.default_rng(3).random((13, 13, 13)) < 0.3
    mask = voxel_table(spark, volume)
    plan = projection.plan_of(spark, 1.0, 6.0, 24).collect()
    assert len(plan) == 1
    gap = 5 / (plan[0].shells - 1)
    sampled = projection.sample_sphere(mask, (13, 13, 13), plan[0].intervals, 1.0, gap, plan[0].shells)
    every = sampled.withColumn("score", F.lit(1))
    found = {(r.t, r.y, r.x) for r in projection.push_spherical(every, (13, 13, 13), (13, 13, 13), plan[0].intervals, 1.0, gap, plan[0].shells).collect()}
    inside = {tuple(map(int, p)) for p in np.argwhere(volume) if 1 <= np.linalg.norm(p - 6.0) <= 6}
    # a voxel comes back if its nearest sample looked at it; the SQL pull tells which exactly
    assert len(found & inside) > 0.8 * len(inside)
    near = {(a + i, b + j, c + k) for a, b, c in map(tuple, np.argwhere(volume)) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)}
    assert found <= near


def test_bands_of_a_known_volume(spark):
    plan = projection.plan_of(spark, 2048 / (4 * np.pi), (2911 - 1) / 2, 2048).orderBy("band").collect()
    assert (sum(r.frames for r in plan), sum(r.shells for r in plan) - 7, {r.intervals for r in plan}, sum(6 * r.patches**2 for r in plan)) == (5430, 898, {2046}, 48)
    assert all(a.high == b.low for a, b in zip(plan, plan[1:]))


def brute_assignment(pairs):
    """The greatest total of one-to-one pairs."""
    if not pairs:
        return 0.0
    (a, b), rest = pairs[0], pairs[1:]
    score = brute_assignment.scores[a, b]
    return max(brute_assignment(rest), score + brute_assignment([p for p in rest if a not in p[:1] and b not in p[1:]]))


def test_assignment_within_components(spark):
    rng = random.Random(3)
    scores = {}
    for c in range(12):
        for a, b in itertools.product(range(rng.randint(1, 3)), range(rng.randint(1, 3))):
            if rng.random() < 0.7:
                scores[10 * c + a, 10 * c + b] = round(rng.random(), 3)
    brute_assignment.scores = scores
    found = tracks.assign(spark.createDataFrame([(a, b, s) for (a, b), s in scores.items()], "a long, b long, score double")).collect()
    assert len({r.a for r in found}) == len({r.b for r in found}) == len(found)
    blocks = {}
    for a, b in scores:
        blocks.setdefault(a // 10, []).append((a, b))
    assert sum(r.score for r in found) == pytest.approx(sum(map(brute_assignment, blocks.values())))


def test_small_components_are_dealt_to_tasks_by_their_number(spark):
    score = np.random.default_rng(4).random((3000, 2, 2)) + 0.01
    rows = [(2 * c + i, 2 * c + j, float(score[c, i, j])) for c, i, j in np.ndindex(score.shape)]
    found = tracks.assign(spark.createDataFrame(rows, "a long, b long, score double")).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.a for r in found}) == len({r.b for r in found}) == len(found) == 6000
    assert sum(r.score for r in found) == pytest.approx(np.maximum(score[:, 0, 0] + score[:, 1, 1], score[:, 0, 1] + score[:, 1, 0]).sum())
    assert len({r.task for r in found}) > 1  # a few bytes a component, so all once fell to one task


def test_matches_and_hypotheses_of_planted_tracklets(spark):
    # left 1 is one object seen whole on the right; left 2 is split in two there; lefts 3 and 4 are parts of one there; left 5 has two near-equal candidates
    square = lambda y0, y1, x0, x1: [(y, x) for y in range(y0, y1) for x in range(x0, x1)]
    left = {1: square(0, 6, 0, 6), 2: square(10, 16, 0, 12), 3: square(20, 26, 0, 6), 4: square(20, 26, 6, 12), 5: square(30, 36, 0, 6)}
    right = {11: square(0, 6, 0, 6), 21: square(10, 16, 0, 6), 22: square(10, 16, 6, 12), 31: square(20, 26, 0, 12), 51: square(30, 36, 0, 6), 52: square(30, 36, 0, 6)[1:]}
    voxels = lambda side: spark.createDataFrame([(o, f, y, x) for o, cells in side.items() for f in range(4) for y, x in cells], "obj int, frame int, y int, x int")
    frames = lambda side: spark.createDataFrame([(o, f, 0.9) for o in side for f in range(4)], "obj int, frame int, p double")
    given = (voxels(left), voxels(right), frames(left), frames(right))
    assessed = tracks.assess(tracks.overlap_metrics(*given, diagonal=60.0)).cache()
    matched = tracks.match(assessed)
    assert {(r.a, r.b) for r in matched.collect()} == {(1, 11)}
    failed = {(r.a, r.b): list(r.failed) for r in assessed.collect()}
    assert failed[5, 51] == ["left_runner_up_margin_below_minimum"] and set(failed[5, 52]) == {"left_runner_up_margin_below_minimum"}
    found = {(r.kind, r.key): (list(r.members), round(r.iou, 6), round(r.gain, 6)) for r in tracks.hypotheses(assessed, matched, *given, diagonal=60.0).collect()}
    assert found == {("split", 2): ([21, 22], 1.0, 0.5), ("merge", 31): ([3, 4], 1.0, 0.5)}
    loose = tracks.assess(assessed.drop("failed", "similarity", "left_margin", "right_margin", "candidate"), min_margin=0.0)
    assert {(r.a, r.b) for r in tracks.match(loose, 0.0).collect()} >= {(1, 11), (5, 51)}


def test_unions_out_of_reach_are_left_out_before_voxels_are_read(spark, monkeypatch):
    # right 23 shares two thirds of left 2, but most of it lies beyond: no union with it can reach the bounds, so its masks are not sent
    square = lambda y0, y1, x0, x1: [(y, x) for y in range(y0, y1) for x in range(x0, x1)]
    sides = ({2: square(10, 16, 0, 12)}, {21: square(10, 16, 0, 6), 22: square(10, 16, 6, 12), 23: square(12, 40, 0, 12)})
    voxels = [spark.createDataFrame([(o, f, y, x) for o, cells in side.items() for f in range(4) for y, x in cells], "obj int, frame int, y int, x int") for side in sides]
    frames = [spark.createDataFrame([(o, f, 0.9) for o in side for f in range(4)], "obj int, frame int, p double") for side in sides]
    assessed = tracks.assess(tracks.overlap_metrics(*voxels, *frames, diagonal=60.0)).cache()
    assert assessed.count() == 3
    rate, rated = tracks._union_metrics, []
    monkeypatch.setattr(tracks, "_union_metrics", lambda unions, *more: rated.extend(sorted(r.members) for r in unions.collect()) or rate(unions, *more))
    found = tracks.hypotheses(assessed, tracks.match(assessed), *voxels, *frames, diagonal=60.0).collect()
    assert rated == [[21, 22]] and [(r.kind, r.key, list(r.members)) for r in found] == [("split", 2, [21, 22])]


def test_masks_of_a_band_are_shuffled_once(spark, data):
    masks = tracks.mask_rows_of(adapters.band(spark, data), F.col("pct") >= 92, by=("supplier",))
    assert masks._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert masks.select("side", "obj", "frame").distinct().count() == masks.count()


def test_repeated_voxels_are_in_a_mask_once_without_a_grouping_before(spark, data):
    seen = [(0, 1, 0, -2, 3, 95), (0, 1, 0, -2, 3, 99), (0, 1, 0, -2, 3, 90), (0, 1, 0, 4, -5, 92), (0, 1, 1, 6, 6, 91), (1, 1, 0, 7, 8, 100)]
    rows = spark.createDataFrame(seen, "side int, obj int, frame int, y int, x int, pct int")
    masks = {(r.side, r.obj, r.frame): r for r in tracks.mask_rows_of(rows, F.col("pct") >= 92).collect()}
    assert {k: (r.p, r.area, r.cy, r.cx, sorted(r.cells)) for k, r in masks.items()} == {
        (0, 1, 0): (0.99, 2, 1.0, -1.0, sorted([(-2 << 32) + 3, (4 << 32) - 5])),
        (0, 1, 1): (0.91, 0, None, None, []),
        (1, 1, 0): (1.0, 1, 7.0, 8.0, [(7 << 32) + 8]),
    }
    plan = tracks.mask_rows_of(adapters.band(spark, data), F.col("pct") >= 92, by=("supplier",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == plan.count("ObjectHashAggregate") > 0  # voxels were grouped on their own before


def test_blocks_are_stored_in_few_files(spark, monkeypatch):
    monkeypatch.setattr(tracks, "BLOCK", 4)
    rows = spark.range(200).select("id", (F.col("id") % 50).alias("frame"), F.lit(1).alias("area")).withColumnRenamed("id", "obj")
    placed = tracks._blocks(rows)
    found = placed.collect()
    assert len(placed.inputFiles()) == 1 and len(found) == len({r.obj for r in found}) == 200  # a file a block before
    spans = {}
    for r in found:
        spans.setdefault(r.block, []).append((r.obj % 50, r.obj))
    ordered = sorted(spans.values())
    assert len(spans) >= 25 and all(max(a) < min(b) for a, b in zip(ordered, ordered[1:], strict=False))


def test_packets_are_reduced_into_a_view_or_rejected(spark):
    rng = np.random.default_rng(5)
    view = np.zeros((3, 20, 150), bool)
    cells, places = [], []
    for k, (y0, x0, h, w) in enumerate([(0, 0, 12, 70), (8, 60, 12, 90), (2, 63, 5, 3)]):
        tile = rng.random((3, h, w)) < 0.1
        tile[1] = False  # an empty frame has no packet
        view[:, y0 : y0 + h, x0 : x0 + w] |= tile
        cells += [(f"a{k}", int(t), int(y), int(x)) for t, y, x in np.argwhere(tile)]
        places.append((f"a{k}", 0, 3, h, w, y0, x0))
    tiles_ = spark.createDataFrame([*places, ("none", 0, 3, 4, 4, 0, 0)], "artifact string, frame_start int, frames int, height int, width int, y0 int, x0 int")
    made = packets.pack(spark.createDataFrame(cells, "artifact string, frame int, y int, x int")).cache()
    for r in made.collect():  # rows of bits, lowest first
        own = np.zeros((r.height, r.width), np.uint8)
        for a, t, y, x in cells:
            if (a, t) == (r.artifact, r.frame):
                own[y - r.top, x - r.left] = 1
        assert bytes(r.payload) == np.packbits(own, axis=1, bitorder="little").tobytes() and r.foreground == own.sum()
    declared = packets.declare(made, tiles_).cache()
    reduced = packets.into_view(packets.words(packets.checked(made, declared)))
    found = np.zeros_like(view)
    for r in reduced.collect():
        for bit in range(64):
            if r.bits >> bit & 1:
                found[r.frame, r.y, r.word * 64 + bit] = True
    assert (found == view).all()
    # the digest of a plane does not depend on how it was dealt into artifacts
    whole = packets.pack(spark.createDataFrame([("one", int(t), int(y), int(x)) for t, y, x in np.argwhere(view)], "artifact string, frame int, y int, x int"))
    one = packets.declare(whole, spark.createDataFrame([("one", 0, 3, 20, 150, 0, 0)], tiles_.schema))
    digests = lambda v: {(r.frame, r.foreground, r.digest) for r in packets.view_digests(v).collect()}
    assert digests(reduced) == digests(packets.into_view(packets.words(packets.checked(whole, one))))
    first = F.col("artifact") == "a0"
    change = lambda c, v: made.withColumn(c, F.when(first, v).otherwise(F.col(c)))
    wrong = {
        "other digest": (change("payload", F.expr("concat(substring(payload, 2), substring(payload, 1, 1))")), declared),
        "frame out of range": (made, declared.withColumn("frames", F.lit(2))),
        "outside its tile": (change("left", F.col("left") + 5), declared),
        "wrong packed size": (change("stride", F.col("stride") + 1), declared),
        "not contiguous": (change("at", F.col("at") + F.col("frame")), declared),
        "other totals": (made, declared.withColumn("pixels", F.col("pixels") + 1)),
        "out of order or twice|other totals": (made.unionByName(made.where(first).limit(1)), declared),
        "without an artifact": (made, declared.where(~first)),
    }
    for message, (rows, head) in wrong.items():
        with pytest.raises(Exception, match=message):
            packets.checked(rows, head).collect()
    bits = made.withColumn("foreground", F.col("foreground") + F.when(first & (F.col("frame") == 0), 1).when(first, -1).otherwise(0))
    with pytest.raises(Exception, match="differs from its payload"):
        packets.words(packets.checked(bits, packets.declare(bits, tiles_))).collect()


def test_volumes_are_read_by_slabs(spark, tmp_path):
    rng = np.random.default_rng(2)
    header = "NRRD0004\ntype: uint8\ndimension: 3\nsizes: 6 5 7\nencoding: %s\n\n"
    wanted = set()
    for name, encoding in (("a", "raw"), ("b", "gzip")):
        volume = (rng.random((7, 5, 6)) < 0.4).astype(np.uint8)
        data = volumes.gzip.compress(volume.tobytes()) if encoding == "gzip" else volume.tobytes()
        (tmp_path / f"{name}.nrrd").write_bytes((header % encoding).encode() + data)
        wanted |= {(name, *map(int, p)) for p in np.argwhere(volume)}
    spark.dataSource.register(volumes.NrrdSlabs)
    read = spark.read.format("nrrd_slabs").option("planes", 2)
    for rows in (read.option("shape", "7,5,6").load(str(tmp_path)), volumes.read_nrrd_runs(spark, str(tmp_path))):
        cells = maskset.voxels(rows.withColumn("path", F.regexp_extract("path", "([ab]).nrrd$", 1)))
        assert {(r.path, r.t, r.y, r.x) for r in cells.collect()} == wanted
    assert read.load(str(tmp_path)).rdd.getNumPartitions() == 4 + 1  # four slabs of the raw volume, one of the other
    assert [t for t, _ in volumes.nrrd_planes(io.BytesIO((tmp_path / "b.nrrd").read_bytes()), 3, 5)] == [3, 4]
    with pytest.raises(Exception, match="has shape"):
        read.option("shape", "7,5,5").load(str(tmp_path)).count()
    files = spark.read.format("binaryFile").load(str(tmp_path))
    layers = lambda *rows: spark.createDataFrame(rows, "filename string, shape string")
    assert volumes.check_shapes(files, layers(("a.nrrd", "7,5,6"), ("b.nrrd", "7,5,6"))).count() == 2
    for rows, message in (((("a.nrrd", "7,5,7"),), "other shape"), ((("c.nrrd", "7,5,6"),), "no volume")):
        with pytest.raises(Exception, match=message):
            volumes.check_shapes(files, layers(*rows)).collect()
    (tmp_path / "c.nrrd").write_bytes((header % "raw").encode() + b"\x01" * 10)
    with pytest.raises(Exception, match="length of its shape"):
        read.option("shape", "").load(str(tmp_path)).count()


def test_windows_count_events_however_late(spark, tmp_path):
    schema = "at timestamp, kind string"
    for k, days in enumerate((20, 21, 1)):  # the last file is long behind the first
        rows = spark.sql(f"SELECT timestamp'2024-01-01 00:30:00' + make_interval(0, 0, 0, {days}) AS at, 'k' AS kind FROM range(3)")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    stream = state.windowed_counts(state.file_stream(spark, str(tmp_path / "e"), schema), "at", "6 hours", None, "kind")
    found = state.run_available(stream)
    assert {r.start.day: r.n for r in found.groupBy("start").agg(F.max_by("n", "batch").alias("n")).collect()} == {21: 3, 22: 3, 2: 3}


def test_planted_bulges_are_found_and_plain_tubes_left_alone(spark):
    grid = np.indices((50, 40, 90))
    t, y, x = grid
    center_y = 18 + 6 * np.sin(t / 9)
    bent = (y - center_y) ** 2 + (x - 15) ** 2 <= 3.3**2
    bulged = (y - center_y) ** 2 + (x - 45) ** 2 <= np.where((t >= 22) & (t <= 28), 6.5, 3.3) ** 2
    at_end = (y - center_y) ** 2 + (x - 75) ** 2 <= np.where(t >= 46, 6.5, 3.3) ** 2
    found = centerline.tube_bulges(voxel_table(spark, bent | bulged | at_end), (40, 90), 12).collect()
    branches = {r.branch: int((r.branch & (1 << 21) - 1)) for r in found}  # a branch is its first voxel
    near = lambda at: [r for r in found if abs(branches[r.branch] - at) <= 8]
    assert not near(15)
    assert [(r.clean, r.reliable) for r in near(45)] == [(True, True)] and near(45)[0].peak > 1.6
    # along the bent branch the bulge's planes lie a little further apart than their numbers
    assert 19 <= near(45)[0].first <= 27 and near(45)[0].last - near(45)[0].first in range(5, 12)
    assert all(not r.clean for r in near(75))  # nothing behind it tells what is normal
    tube = voxel_table(spark, bent)
    widths = centerline.section_widths(tube, centerline.ridge(topology.slice_components(tube, 8), (40, 90)), 12).collect()
    assert all(r.whole and abs(r.radius - 3.3) < 0.6 for r in widths[3:-3]) and len(widths) >= 50


def test_sections_are_measured_where_their_voxels_meet(spark):
    from lamina.functions import planes

    rng = np.random.default_rng(17)
    cells = {(int(t), int(y), int(x)) for t, y, x in zip(*np.nonzero(rng.random((12, 90, 100)) < 0.35))}
    mask = spark.createDataFrame([(t, y - 10, x) for t, y, x in cells], "t int, y int, x int")  # some places lie before the first
    points = spark.createDataFrame([(b, k, float(k), 4.0 * k + 20 * b - 8, 58.0 + b + 2 * k) for b in range(4) for k in range(6)], "branch long, ord int, t double, y double, x double")
    found = centerline.section_widths(mask, points, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and plan.count("Exchange rangepartitioning") == 0  # each place of a section was a row, pixels were numbered and labelled as a graph
    got = {(r.branch, r.s): (round(r.radius, 9), r.whole) for r in found.collect()}
    drawn = geometry.section_raster(geometry.transport_frames(geometry.centerline_samples(points)), mask.withColumn("value", F.lit(1)), 11, categorical=True)
    sections = {}
    for r in drawn.collect():
        sections.setdefault((r.branch, r.s), np.zeros((11, 11), bool))[r.row, r.col] = True
    want = {}
    for key, plane in sections.items():
        parts = planes.parts_2d(plane, diagonal=True)
        _, _, number = min(((y - 5) ** 2 + (x - 5) ** 2, tuple(np.argwhere(parts == parts[y, x])[0]), parts[y, x]) for y, x in np.argwhere(plane))
        own = parts == number
        want[key] = (round(float(np.sqrt(own.sum() / np.pi)), 9), not (own[[0, -1]].any() or own[:, [0, -1]].any()))
    assert got == want and len(got) > 40 and len({v[1] for v in got.values()}) == 2


def test_components_solved_where_they_lie_first(spark, monkeypatch):
    from lamina.operators import graph

    rng = np.random.default_rng(4)
    edges = [(int(a), int(a + d)) for a, d in zip(rng.integers(0, 900, 600), rng.integers(1, 4, 600))]
    df = spark.createDataFrame(edges, "a long, b long")
    want = {tuple(r) for r in graph.connected_components(df, one_task=10**6).collect()}
    rounds = []
    monkeypatch.setattr(graph, "_large_star", lambda *a: rounds.append(1))
    found = graph.connected_components(df, one_task=400, near=lambda node: F.floor(F.col(node) / 100))  # rounds of joins before
    assert {tuple(r) for r in found.collect()} == want and len(want) > 500 and not rounds
    # small planes by all pairs of cells, as larger ones by columns and rows
    from lamina.functions import planes

    plane = rng.random((14, 15)) < 0.8
    small = planes.distance_to_background(plane)
    monkeypatch.setattr(planes, "FEW_CELLS", 0)
    assert np.array_equal(small, planes.distance_to_background(plane)) and small.max() > 1


def test_guards_of_bulges(spark):
    def runs(values, **guards):
        rows = [(1, k, float(v), True) for k, v in enumerate(values)]
        return [tuple(r)[1:] for r in centerline.bulges(spark.createDataFrame(rows, "branch long, s int, radius double, whole boolean"), **guards).select("branch", "first", "last", "samples", "clean", "reliable").orderBy("first").collect()]

    plain = [2.0] * 12
    assert runs(plain * 3) == []
    assert runs([*plain, 4, 4, 4, *plain]) == [(12, 14, 3, True, True)]
    assert runs([*plain, 4, 4, *plain]) == []  # too short
    assert runs([*plain, 4, 4, 2, 2, 4, *plain]) == [(12, 16, 3, True, True)]  # a gap is closed
    assert runs([2.0, 2, 4, 4, 4, *plain, *plain]) == [(2, 4, 3, False, True)]  # no flank before it
    jumpy = [2.0, 2, 2, 4, 4, 4] * 6
    assert all(not r[-1] for r in runs(jumpy, factor=1.3, context=3))


def test_pairs_of_tracklets_meet_by_blocks(spark, monkeypatch):
    # 30 x 30 tracklets, some in frames of their own, on a plane with negative and far coordinates; blocks of 4 and of all give the same, and so do unions
    rng = np.random.default_rng(8)
    draw = lambda: {(o, int(f), int(y), int(x)) for o in range(30) for f in rng.choice(9, 4, replace=False) + 20 * (o // 12) for y, x in rng.integers(-3, 3, (5, 2)) * (1, 70_000)}
    sides = [spark.createDataFrame(sorted(draw()), "obj int, frame int, y int, x int") for _ in range(2)]
    frames = [df.select("obj", "frame").distinct().union(spark.createDataFrame([(3, 500)], "obj int, frame int")).withColumn("p", F.lit(0.8)) for df in sides]
    found = []
    for block in (512, 4):
        monkeypatch.setattr(tracks, "BLOCK", block)
        metrics = tracks.overlap_metrics(*sides, *frames, diagonal=9.0)
        # a pair's frames meet in the group of its blocks: nothing is joined, sent or grouped by pair and frame
        assert metrics._jdf.queryExecution().sparkPlan().nodeName() == "FlatMapGroupsInArrow"
        found.append({tuple(r) for r in metrics.collect()})
    assert found[0] == found[1] and len(found[0]) == len({r[:2] for r in found[0]}) > 100
    common = sides[0].join(sides[1].withColumnRenamed("obj", "b"), ["frame", "y", "x"]).groupBy("obj", "b").count().collect()
    place = metrics.columns.index("intersection")
    assert {(r.obj, r.b, r["count"]) for r in common} == {(r[0], r[1], r[place]) for r in found[0]}
    rows = [tracks.mask_rows(v, f) for v, f in zip(sides, frames)]
    best = lambda rows, k: {(a, iou) for a in range(30) for iou in sorted((r[1] for r in rows if r[0] == a), reverse=True)[:k]}
    few = [(r.a, r.iou) for r in tracks.overlap_of_rows(*rows, 9.0, ("iou",), best=2).collect()]
    assert len(few) < len(found[0]) and best(few, 2) == best([(r[0], r[metrics.columns.index("iou")]) for r in found[0]], 2)


def test_masks_are_shuffled_once_to_meet(spark, data):
    rows = stored(tracks.mask_rows_of(adapters.band(spark, data), F.col("pct") >= 92))
    found = tracks.overlap_of_rows(*[rows.where(F.col("side") == k) for k in (0, 1)], 2048**0.5, ("iou",))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Exchange ") == 1 and "SortMergeJoin" not in plan  # to the pairs of blocks; blocks and meetings are broadcast


def _full_sides(spark, n=30, frames=6):
    """Two sides of tracklets that nearly all share frames; some frames are missing, some masks are empty, some probabilities unknown."""
    rng = np.random.default_rng(21)
    sides = []
    for side in range(2):
        voxels = {(o, f, int(y), int(x)) for o in range(n) for f in range(frames) if rng.random() < 0.9 for y, x in rng.integers(-3, 3, (int(rng.integers(0, 9)), 2)) * (1, 70_000)}
        seen = sorted({v[:2] for v in voxels} | {(o, 0) for o in range(n)})
        rows = [(o, f, None if (o + f) % 11 == side else 0.5 + (o + f) % 5 / 10) for o, f in seen]
        sides.append(tracks.mask_rows(spark.createDataFrame(sorted(voxels), "obj int, frame int, y int, x int"), spark.createDataFrame(rows, "obj int, frame int, p double")).cache())
    return sides


def test_blocks_that_all_meet_are_read_where_they_meet(spark, monkeypatch):
    sides = _full_sides(spark)
    rows = lambda df: {tuple(None if v is None else round(v, 12) for v in r) for r in df.collect()}
    want = tracks.overlap_of_rows(*sides, 9.0)
    assert want._jdf.queryExecution().sparkPlan().nodeName() == "FlatMapGroupsInArrow"  # a few blocks are sent
    monkeypatch.setattr(tracks, "BLOCK", 4)
    found = tracks.overlap_of_rows(*sides, 9.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # masks were sent to each of the 64 meetings of blocks before
    assert "CartesianProduct" in plan and "Exchange" not in plan and found.rdd.getNumPartitions() > 36
    assert rows(found) == rows(want) and found.count() > 500
    # the best of each left tracklet are there, with their own metrics
    few, every = (sorted((r.a, -r.iou, r.b) for r in df.select("a", "b", "iou").collect()) for df in (tracks.overlap_of_rows(*sides, 9.0, ("iou", "apart_median"), best=2), want))
    best = lambda pairs: {p for a in range(30) for p in [p for p in pairs if p[0] == a][:2]}
    assert len(few) < len(every) and {p[:2] for p in best(few)} == {p[:2] for p in best(every)} and set(few) <= set(every)


def test_metrics_become_columns_in_their_task_as_in_spark(spark):
    from lamina.plans.catalog_geometry import _accepted

    sides = _full_sides(spark)
    metrics = tracks.overlap_of_rows(*sides, 9.0)
    want = metrics.select("a", "b", F.concat_ws(",", tracks.gate_failures()).alias("failed"), F.round(tracks.similarity(), 8).alias("score"), (F.col("drift_median") <= 0.7).alias("area"), ((F.col("iou") >= 0.05) & (F.col("drift_median") <= 0.7) & (F.col("frames") >= 3)).alias("accepted"))
    made = lambda found: {"code": tracks.gate_codes(found), "score": tracks.rounded(tracks.similarities(found)), **_accepted(found)}
    found = tracks.overlap_of_rows(*sides, 9.0, then=made, columns="code int, score double, recall_ok boolean, area_ok boolean, accepted boolean")
    found = found.select("a", "b", tracks.gate_reasons(F.col("code")).alias("failed"), "score", F.col("area_ok").alias("area"), "accepted")
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()}
    assert tracks.rounded(np.array([1 / 512, 0.0, 0.3, np.nan]))[:3].tolist() == [0.00195313, 0.0, 0.3]  # half up


def test_sessions_are_those_of_a_plain_first_fit(spark):
    rng = np.random.default_rng(6)
    masks = {(f, o): {(int(y), int(x)) for y, x in rng.integers(-2, 9, (int(rng.integers(1, 20)), 2))} for f in range(3) for o in range(40)}
    want = set()
    for f in range(3):
        sessions = []
        for o in sorted(range(40), key=lambda o: (-len(masks[f, o]), o)):
            for number, members in enumerate([*sessions, []]):
                every = [*members, o]
                alone = lambda m: masks[f, m].difference(*(masks[f, q] for q in every if q != m))  # noqa: B023, E731
                if len(every) <= 3 and all(100 * len(alone(m)) >= 50 * len(masks[f, m]) for m in every):
                    sessions[number:] = [every, *sessions[number + 1 :]]
                    want.add((f, o, number))
                    break
    seeds = spark.createDataFrame([(f, o, y, x) for (f, o), cells in masks.items() for y, x in cells], "frame int, obj long, y int, x int")
    assert {tuple(r) for r in tracks.seed_sessions(seeds, 3, 50).collect()} == want
    # a frame of many objects that hardly share a session: sets took a comparison for each pair of them
    bits = rng.integers(0, 2**63, (20_000, 1)).astype(np.uint64)
    start = time.time()
    assert tracks._first_fit(bits, np.bitwise_count(bits).sum(1).astype(np.int64), 8, 50).max() > 3000
    assert time.time() - start < 60


def test_crops_of_many_objects_need_no_table_of_pairs(spark):
    from lamina.operators import geometry

    rng = np.random.default_rng(11)
    low = rng.integers(0, 14, (60, 2))
    box = np.column_stack([low, low + rng.integers(1, 5, (60, 2))])
    members, boxes = [[k] for k in range(60)], [list(map(int, b)) for b in box]
    while True:  # the plain way: all pairs, the first of the least
        pairs = []
        for i, j in itertools.combinations(range(len(boxes)), 2):
            (a, b, c, d), (e, f, g, h) = boxes[i], boxes[j]
            joint = [min(a, e), min(b, f), max(c, g), max(d, h)]
            if joint[2] - joint[0] <= 6 and joint[3] - joint[1] <= 6 and len(members[i] + members[j]) <= 3:
                pairs.append(((joint[2] - joint[0]) * (joint[3] - joint[1]), i, j, joint))
        if not pairs:
            break
        _, i, j, boxes[i] = min(pairs)
        members[i] += members.pop(j)
        del boxes[j]
    df = spark.createDataFrame([(0, k, *map(int, b[[0, 2, 1, 3]])) for k, b in enumerate(box)], "frame int, obj long, y0 int, y1 int, x0 int, x1 int")
    found = {tuple(r) for r in geometry.dynamic_crops(df, 6, 3).collect()}
    assert found == {(0, k, o, b[0], b[2], b[1], b[3]) for k, (ids, b) in enumerate(zip(members, boxes)) for o in ids}
    # 60,000 objects in a frame: all pairs at once would take 29 GB an array
    wide = spark.range(60_000).select(F.lit(0).alias("frame"), F.col("id").alias("obj"), *[F.lit(v).alias(c) for c, v in (("y0", 0), ("y1", 9), ("x0", 0), ("x1", 2))])
    rows = geometry.dynamic_crops(wide, 8, 4)
    assert rows.count() == rows.select("crop").distinct().count() == 60_000


def test_samples_of_sections_are_dealt_before_they_become_places(spark):
    line = spark.range(40).select(F.col("id").alias("branch"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("ord")).select("branch", "ord", *[F.col("ord").cast("double").alias(c) for c in "tyx"])
    frames = geometry.transport_frames(geometry.centerline_samples(line))
    voxels = spark.range(1000).selectExpr("cast(id div 100 as int) t", "cast(id div 10 % 10 as int) y", "cast(id % 10 as int) x", "7 value")
    drawn = geometry.section_raster(frames, voxels, 5)
    # neither pixels nor the corners of places are grouped or sent: a place meets its eight voxels as one row
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")] and "RepartitionByExpression [branch" in plan
    assert drawn.select("branch").distinct().count() == 40 and {r.value for r in drawn.select("value").distinct().collect()} <= set(range(1, 8))
