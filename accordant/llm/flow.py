"""Min-cost flow on small graphs with integer capacities, by successive shortest paths."""

from __future__ import annotations

from collections import deque


class Network:
    def __init__(self) -> None:
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def arc(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        """An arc's number; its flow is ``flow(number)``."""
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def flow(self, arc: int) -> int:
        return self.left[arc ^ 1]

    def reached(self, source: int) -> set[int]:
        """The nodes that more flow could still reach: after ``run`` the source's side of a least cut."""
        seen, todo = {source}, [source]
        while todo:
            for e in self.out[todo.pop()]:
                if self.left[e] and self.to[e] not in seen:
                    seen.add(self.to[e])
                    todo.append(self.to[e])
        return seen

    def run(self, source: int, sink: int) -> tuple[int, int]:
        """The largest flow and its least cost."""
        total = spent = 0
        while True:
            far: list[int | None] = [None] * len(self.out)
            via = [-1] * len(self.out)
            far[source] = 0
            queue, waiting = deque([source]), [False] * len(self.out)
            while queue:
                v = queue.popleft()
                waiting[v] = False
                for e in self.out[v]:
                    w = self.to[e]
                    if self.left[e] and (far[w] is None or far[v] + self.cost[e] < far[w]):
                        far[w], via[w] = far[v] + self.cost[e], e
                        if not waiting[w]:
                            waiting[w] = True
                            queue.append(w)
            if far[sink] is None:
                return total, spent
            push, v = None, sink
            while v != source:
                push = self.left[via[v]] if push is None else min(push, self.left[via[v]])
                v = self.to[via[v] ^ 1]
            v = sink
            while v != source:
                self.left[via[v]] -= push
                self.left[via[v] ^ 1] += push
                v = self.to[via[v] ^ 1]
            total += push
            spent += push * far[sink]
