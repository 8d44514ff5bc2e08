"""The single-node engine's model files, both forms, in and out."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.test_models import random_tree
from thicket.functions import objectives as O
from thicket.operators.forest import Forest
from thicket.operators.model import GBDTModel
from thicket.queries import fixed_model, linear_model
from thicket.sources import interchange as I
from thicket.sources.persist import ReadError

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text(), lambda c: st.lists(c, max_size=5) | st.dictionaries(st.text(max_size=40), c, max_size=5), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(VALUES)
def test_message_pack_round_trip(x):
    assert I.unpack(I.pack(x)) == x


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_odd_bytes_are_read_errors(data):
    for f in (I.read, I.read_binary, I.read_json):
        with pytest.raises(ReadError):
            f(data)
    try:
        I.unpack(data)
    except ReadError:
        pass


@pytest.mark.parametrize("compress", [True, False])
def test_models_round_trip(compress):
    rng = np.random.default_rng(3)
    m = GBDTModel(Forest([random_tree(rng) for _ in range(6)], [0.5, -1.0, 2.0]), tuple("abcd"), O.softmax_loss(3))
    for i, t in enumerate(m.forest.trees):
        t.group = i % 3
    x = rng.normal(size=(50, 4)).round(1)
    x[rng.random(x.shape) < 0.2] = np.nan
    for again in (I.read(I.write_binary(m, compress)), I.read(I.write_json(m))):
        assert np.array_equal(again.forest.margins(x), m.forest.margins(x)) and again.objective == m.objective and again.features == m.features
    x = np.column_stack([rng.uniform(0, 50, 30), rng.uniform(0, 0.1, 30), rng.integers(0, 3, 30)])
    assert np.array_equal(I.read(I.write_json(fixed_model())).forest.margins(x), fixed_model().forest.margins(x))
    assert (I.read(I.write_binary(linear_model(), compress)).weights == linear_model().weights).all()
    bad = bytearray(I.write_binary(m, compress))
    bad[40] ^= 1
    with pytest.raises(ReadError) as e:
        I.read(bytes(bad))
    assert e.value.kind == "checksum"


def test_a_written_out_model():
    """A tree of three nodes at 0.5, and one whose categories {1} go right."""
    tree = {"num_nodes": 3, "split_indices": [0, 0, 0], "thresholds": [0.5, 0.0, 0.0], "children_left": [1, 0, 0], "children_right": [2, 0, 0], "default_left": [True, False, False], "leaf_values": {"type": "scalar", "values": [0.0, 1.0, 2.0]}}
    cat = {**tree, "split_indices": [1, 0, 0], "default_left": [False, False, False], "categories": {"node_indices": [0], "category_sets": [[1]]}}
    body = {"meta": {"num_features": 2}, "forest": {"trees": [tree, cat], "n_groups": 1, "base_score": [0.25]}, "output_transform": "identity"}
    m = I.model_of("gbdt", body)
    x = np.array([[0.4, 0.0], [0.5, 1.0], [np.nan, 7.0], [0.4, np.nan]])
    assert m.forest.margins(x)[0].tolist() == [0.25 + 1 + 1, 0.25 + 2 + 2, 0.25 + 1 + 1, 0.25 + 1 + 2]
