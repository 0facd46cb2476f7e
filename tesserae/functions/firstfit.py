"""First fit under two caps, by a tree over the room that is left."""

from __future__ import annotations


class Rooms:
    """Shards in order of their opening, with what room each has left. A node holds the most bytes and the most items of its shards."""

    def __init__(self, most_bytes: int, most_items: int):
        self.caps, self.width, self.n = (most_bytes, most_items), 1, 0
        self.room = [[0, 0], [0, 0]]

    def _grow(self) -> None:
        old, self.width = self.width, 2 * self.width
        room = [[-1] * (2 * self.width) for _ in range(2)]
        for kind in range(2):
            room[kind][self.width : self.width + old] = self.room[kind][old : 2 * old]
            for i in range(self.width - 1, 0, -1):
                room[kind][i] = max(room[kind][2 * i], room[kind][2 * i + 1])
        self.room = room

    def _set(self, shard: int, left: tuple[int, int]) -> None:
        i = self.width + shard
        for kind in range(2):
            self.room[kind][i] = left[kind]
        i //= 2
        while i:
            for kind in range(2):
                self.room[kind][i] = max(self.room[kind][2 * i], self.room[kind][2 * i + 1])
            i //= 2

    def put(self, size: int, items: int = 1) -> int:
        """The first shard with room for so many bytes and items, which takes them; a new one if there is none."""
        b, c = self.room
        todo = [1] if self.n else []
        while todo:
            i = todo.pop()
            if b[i] < size or c[i] < items:
                continue
            if i >= self.width:
                self._set(i - self.width, (b[i] - size, c[i] - items))
                return i - self.width
            todo += [2 * i + 1, 2 * i]  # the left one first
        if self.n == self.width:
            self._grow()
        self._set(self.n, (self.caps[0] - size, self.caps[1] - items))
        self.n += 1
        return self.n - 1

    def left(self, shard: int) -> tuple[int, int]:
        return self.room[0][self.width + shard], self.room[1][self.width + shard]
