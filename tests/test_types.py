from datetime import datetime

import numpy as np
import pytest

from fluxgate import types as T


@pytest.mark.parametrize(
    ("value", "name", "shape"),
    [
        ([], "CDF_NONE", ()),
        ([1, 2, 3, 4], "CDF_UINT1", (4,)),
        ([[[1] * 3] * 3] * 2, "CDF_UINT1", (2, 3, 3)),
        ([1, 2.0, 3, 4.0], "CDF_DOUBLE", (4,)),
        ([datetime(2020, 1, 1), datetime(2021, 1, 1)], "CDF_TIME_TT2000", (2,)),
        (["a", "de", "ghi"], "CDF_UCHAR", (3, 3)),
        (["√abc", "√def", "√ghi"], "CDF_UCHAR", (3, 6)),
        ([-100, 0, 100, 127], "CDF_INT1", (4,)),
        ([-200, 0, 200, 30000], "CDF_INT2", (4,)),
        ([-70000, 0, 70000, 2000000000], "CDF_INT4", (4,)),
        ([-5000000000, 0, 9000000000000], "CDF_INT8", (3,)),
        ([0, 100, 200, 255], "CDF_UINT1", (4,)),
        ([0, 60000], "CDF_UINT2", (2,)),
        ([0, 4000000000], "CDF_UINT4", (2,)),
        ([0, 10000000000], "CDF_INT8", (2,)),
        (np.zeros((2, 3), "f4"), "CDF_FLOAT", (2, 3)),
        (np.array(["2020-01-01"], "datetime64[ns]"), "CDF_TIME_TT2000", (1,)),
        (np.array(["ab", "c"]), "CDF_UCHAR", (2, 2)),
        (np.zeros(3, "u8"), "CDF_INT8", (3,)),
    ],
)
def test_inference(value, name, shape):
    got = T.infer(value)
    assert got[:2] == (name, shape)


@pytest.mark.parametrize("value", [[None], [{}], [[1, 2], [3, 4, 5]], [[1, 2, 3], "string"], [1, [1, 2, 3]], [1, datetime(2020, 1, 1)], [datetime(2020, 1, 1), 1.0]])
def test_bad_values(value):
    with pytest.raises((ValueError, IndexError)):
        T.infer(value)


def test_boundaries():
    assert [T.smallest_int_type(0, x) for x in (255, 256, 65536, 1 << 32)] == ["CDF_UINT1", "CDF_UINT2", "CDF_UINT4", "CDF_INT8"]
    assert [T.smallest_int_type(x, 0) for x in (-128, -129, -32769, -4294967296)] == ["CDF_INT1", "CDF_INT2", "CDF_INT4", "CDF_INT8"]


def test_compatibility():
    assert T.compatible("CDF_DOUBLE", "CDF_INT4") and not T.compatible("CDF_DOUBLE", "CDF_INT8")
    assert T.compatible("CDF_EPOCH", "CDF_TIME_TT2000") and not T.compatible("CDF_INT2", "CDF_UINT2")


def test_shapes():
    assert T.shapes_compatible((10, 3), (5, 3), False) and not T.shapes_compatible((10, 3), (10, 4), False)
    assert T.shapes_compatible((1, 3), (3,), True) and not T.shapes_compatible((1, 3), (4,), True)


def test_constants():
    assert T.default_fill_value("CDF_TIME_TT2000") == -(1 << 63) and T.default_pad_value("CDF_EPOCH16") == (0.0, 0.0)
    assert T.default_fill_value("CDF_CHAR") is None and T.default_pad_value("CDF_UINT1") == 254
