"""Lists of a device that are read and written once a batch."""

from rankloom.streaming import library as L


class Store:
    """A map of the state store that counts its calls."""

    def __init__(self, rows):
        self.rows, self.calls = dict(rows), 0

    def keys(self):
        self.calls += 1
        return iter(self.rows)

    def getValue(self, key):
        self.calls += 1
        return self.rows[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.rows[key] = value

    def containsKey(self, key):
        self.calls += 1
        return key in self.rows

    def removeKey(self, key):
        self.calls += 1
        del self.rows[key]


def test_library_touches_a_list_once_a_batch():
    store = Store({(0,): ("one", [], 0), (1,): ("two", ["x"], 1)})
    lists, state, device = L._Lists(store), (0, 2, [], []), L.Library()
    for n in range(500):
        done, *state = device.step(n + 2, "add", str(n), None, *state, lists)
        assert done
    device.step(600, "delete", "1", None, *state, lists)
    device.step(601, "new", "three", None, *state, lists)
    lists.save()
    assert store.calls <= 7
    assert store.rows == {(0,): ("one", [str(n) for n in range(500)], 501), (2,): ("three", [], 601)}
