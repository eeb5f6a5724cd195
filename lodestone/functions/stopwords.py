"""Stop-words of the two query languages."""

from __future__ import annotations

#: Words that are left out of English queries and of the index.
ENGLISH = frozenset("""
a an the
in on at to for of with by from as into about through between after before
and or but if then because while although
i you he she it we they this that these those what which who whom whose
is am are was were be been being have has had do does did will would could should may might must can
get use make
how why when where
not no yes so very just also too
""".split())

#: Words that are left out of Chinese queries.
CHINESE = frozenset("""
如何 怎么 怎样 什么 哪个 哪些 为什么 为何 谁 多少 几 是否 能否 可否
的 地 得 了 着 过 吗 呢 吧 啊 呀
在 于 和 与 或 及 并 而 但 但是 因为 所以 如果 那么 虽然 然而
我 你 他 她 它 我们 你们 他们 这 那 这个 那个 这些 那些 这里 那里
很 非常 特别 更 最 都 也 还 又 再 已 已经 正在 将 会 能 可以 应该 必须
是 有 做 进行 使用 通过
个 种 类
？ 。 ！ ， 、
""".split())

#: What queries leave out.
DEFAULT = ENGLISH | CHINESE
