"""Main text of HTML pages by deducing each host's template from equivalence classes of tokens.

A token is an opening tag, a closing tag or a run of text, told apart by the path of elements it
stands in.  Tokens of a host that occur equally often on every page (equal occurrence vectors)
form a class; a class that frames content, holding opening and closing tags, and covers most
pages of the host is valid, and valid classes nest by their paths into the host's template.  What the
template leaves open are slots: their text is content, inside an article element and outside; a run
that the template holds is not, wherever it stands.  Elements that HTML defines as furniture never
hold content; class and id names decide only where the template does not.  A host of few pages takes the
template of its registered domain.  Occurrence vectors are compared by sums over pages, which
combine before the shuffle, so no task ever holds the pages of a host.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coobs.llm.digest_array import host_of
from coobs.llm.tables import cut_lineage

#: Pages a host needs for a template of its own (else the domain's serves), and the share that must hold a token; an article's
#: own text must repeat on more of them.
MIN_PAGES, COVER, COVER_INSIDE = 10, 0.5, 0.8
#: Hosts, and bytes of tokens, whose templates are broadcast; beyond either the lookup is a shuffle join.
BROADCAST_HOSTS, BROADCAST_BYTES = 20_000, 32 << 20

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("aside button canvas datalist dialog embed fieldset footer form frame frameset head header iframe input label legend menu nav noembed noframes noscript object optgroup option script search select style svg template textarea title video audio".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article main section div aside nav footer header form table ul ol dl body".split())
# Words in class, id or role attributes that name page furniture.
NAMES = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adbox|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs"
    r"|sidebar|side|aside|footer|foot|header|masthead|topbar|cookie|cookies|consent|notice|notices|alert|warning|popup|modal|overlay|newsletter|subscribe|signup|login|search|form"
    r"|comment|comments|commentlist|reply|replies|respond|disqus|discussion|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|skip|hidden|toc|contentinfo|complementary)(?:$|[-_\s\d])"
)


# Names that tell furniture even inside an article, words that may stand beside any name, and names of reader comments.
STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs"
    " sidebar cookie cookies consent popup modal overlay newsletter subscribe signup share sharing social related recommended widget toolbar pagination pager".split()
)
BESIDE = frozenset("area bar block body bottom box container content group inner item items left list outer panel right section top unit wrap wrapper".split())
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
#: What kind of furniture an element is, or stands in.
CONTENT, BY_NAME, BY_ELEMENT, BY_COMMENT = 0, 1, 2, 3


def named(tag: str, label: str, inside: bool) -> int:
    """The kind of furniture that class, id and role names tell.

    Outside articles any part of a name will do.  Inside, a section's name is often its heading, so a
    name must be one of ``STRONG`` there, and all its parts must be names or words beside them.
    """
    if not label or not NAMES.search(label):
        return CONTENT
    parts = [re.sub(r"\d+$", "", p) for p in re.split(r"[-_\s]+", label)]
    if COMMENTS & set(parts):
        return BY_COMMENT
    if not inside:
        return BY_NAME
    for name in label.split():
        of = [p for p in (re.sub(r"\d+$", "", p) for p in re.split(r"[-_]+", name)) if p and p not in BESIDE]
        if of and all(p in STRONG if tag in ("section", "h1", "h2", "h3", "h4", "h5", "h6") else NAMES.search(p) for p in of):
            return BY_NAME
    return CONTENT


class Page(HTMLParser):
    """Tokens of a page, and its text runs with what is around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str, int, bool]] = []  # element, path, kind of furniture, in article or main
        self.tokens: Counter = Counter()
        self.kinds: dict[int, int] = {}
        self.runs: list[tuple[int, str, bool, bool, int]] = []  # role, text, furniture, in main, block
        self.block = 0
        self.has_main = False

    def role(self, kind: int, path: str, extra: str = "") -> int:
        h = xxhash.xxh64_intdigest(f"{kind}{path}\x00{extra}") - (1 << 63)
        self.tokens[h] += 1
        self.kinds[h] = kind
        return h

    def close(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, path, _, _ = self.stack.pop()
            self.role(2, path)
            if tag not in INLINE:
                self.block += 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P or tag in SELF_CLOSING:
            ends = SELF_CLOSING.get(tag, {"p"})
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ends:
                    self.close(i)
                    break
                if self.stack[i][0] in SCOPES:
                    break
        given = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "aria-hidden", "style")}
        label = " ".join(given.get(k, "") for k in ("class", "id", "role")).strip().lower()
        path = (self.stack[-1][1] if self.stack else "") + "/" + tag + ("." + label if label else "")
        above, inside = (self.stack[-1][2], self.stack[-1][3]) if self.stack else (CONTENT, False)
        unseen = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        if unseen:
            kind = BY_ELEMENT
        elif tag in ("article", "main") and not inside:
            # what wraps an article is no furniture, whatever it is called; but readers' comments may be articles
            kind = above if above != BY_NAME else CONTENT
            kind = max(kind, BY_COMMENT if COMMENTS & set(re.split(r"[-_\s]+", label)) else CONTENT)
        elif tag == "form":
            kind = max(above, BY_NAME)  # a form may hold the whole page
        elif tag == "header" and inside and not label and above == CONTENT:
            kind = CONTENT  # an article's own heading
        elif tag in FURNITURE:
            kind = max(above, BY_ELEMENT)
        else:
            kind = max(above, named(tag, label, inside) if tag not in ("html", "body") else CONTENT)
        furniture, inside = kind != CONTENT, inside or tag in ("article", "main")
        self.role(1, path)
        if tag in ("article", "main") and not furniture:
            self.has_main = True
        if tag not in INLINE:
            self.block += 1
        elif tag == "br":
            self.runs.append((0, " ", furniture, True, self.block))
        if tag not in VOID:
            self.stack.append((tag, path, kind, inside))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash has no meaning in HTML

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.close(i)
                return
            if tag in INLINE and self.stack[i][0] in SCOPES:
                return

    def handle_data(self, data: str) -> None:
        path, kind, main = self.stack[-1][1:] if self.stack else ("", CONTENT, False)
        role = self.role(8 if main else 4, path, " ".join(data.split())) if not data.isspace() else 0
        self.runs.append((role, data, kind != CONTENT, main, self.block))


def parsed(html: str) -> Page:
    page = Page()
    page.feed(html)
    HTMLParser.close(page)
    Page.close(page, 0)
    return page


def main_text(page: Page, template: frozenset[int]) -> str:
    """Content slots as blocks: of article or main where there is one, else of the whole page.

    A page of which the template would leave nothing is a copy of others; it keeps its text.
    """

    def text(known: frozenset[int]) -> str:
        blocks: dict[int, list[str]] = {}
        for role, data, furniture, main, block in page.runs:
            if not furniture and (main or not page.has_main) and role not in known:
                blocks.setdefault(block, []).append(data)
        joined = (" ".join("".join(parts).split()) for parts in blocks.values())
        return "\n".join(b for b in joined if b)

    return text(template) or (text(frozenset()) if page.has_main else "")


def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles, counts, kinds = [], [], []
        for html in batch.column("_html").to_pylist():
            page = parsed(html)
            roles.append(list(page.tokens))
            counts.append(list(page.tokens.values()))
            kinds.append([page.kinds[r] for r in page.tokens])
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), batch.column("page"), pa.array(roles, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32())), pa.array(kinds, pa.list_(pa.int32()))],
            names=["host", "page", "roles", "counts", "kinds"],
        )


def extract(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, known = [], {}
        for html, host, roles in zip(batch.column("_html"), batch.column("_host"), batch.column("roles")):
            name = host.as_py()
            if name not in known:
                known[name] = frozenset(roles.as_py() or ())
            out.append(main_text(parsed(html.as_py()), known[name]))
        text = pa.array(out, pa.string())
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], text], names=[*names, "text"])


def domain_of(host: Column) -> Column:
    """The registered domain, by rule: the last two labels."""
    return F.substring_index(host, ".", -2)


def host_templates(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(``host``, ``roles``): the tokens of each host's template; a host of few pages has its domain's."""
    given = pages.select(host_of(url).alias("host"), F.xxhash64(html, url).alias("page"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("_html"))
    seen = given.mapInArrow(tokens_of, "host string, page bigint, roles array<bigint>, counts array<int>, kinds array<int>")
    rows = seen.select("host", "page", F.explode(F.arrays_zip("roles", "counts", "kinds")).alias("t")).select("host", "page", "t.*")
    mark = F.xxhash64("page", "counts")
    vectors = rows.groupBy("host", "roles").agg(
        F.count(F.lit(1)).alias("support"),
        F.sum(F.col("counts").cast("bigint")).alias("total"),
        F.bit_xor(mark).alias("x"),
        F.sum(mark.bitwiseAND(F.lit((1 << 28) - 1))).alias("y"),
        F.first("kinds").alias("kind"),
    )
    # sums over a host's pages add up to sums over its domain's
    vectors = cut_lineage(vectors, "template_vectors")  # all of them: what is rare on a host may be frequent on its domain
    sizes = cut_lineage(given.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "template_hosts")
    own = valid_classes(vectors, sizes.where(f"pages >= {MIN_PAGES}"))
    domain = domain_of(F.col("host")).alias("host")
    wide = vectors.groupBy(domain, "roles").agg(
        *[F.sum(c).alias(c) for c in ("support", "total", "y")], F.bit_xor("x").alias("x"), F.first("kind").alias("kind")
    )
    wide_sizes = sizes.groupBy(domain).agg(F.sum("pages").alias("pages"))
    shared = valid_classes(wide, wide_sizes.where(f"pages >= {MIN_PAGES}")).withColumnRenamed("host", "domain")
    few = sizes.where(f"pages < {MIN_PAGES}").select("host", domain_of(F.col("host")).alias("domain"))
    return own.unionByName(few.join(shared, "domain").select("host", "roles"))


def valid_classes(vectors: DataFrame, sizes: DataFrame) -> DataFrame:
    """(``host``, ``roles``) of the classes of equal occurrence vectors that cover enough pages and frame something."""
    need = F.when(F.col("kind") == 8, COVER_INSIDE).otherwise(COVER)
    frequent = vectors.join(sizes, "host").where(F.col("support") >= need * F.col("pages"))
    classes = frequent.groupBy("host", "support", "total", "x", "y").agg(F.collect_list("roles").alias("roles"), F.bit_or("kind").alias("kinds"))
    # a valid class frames something: an element opens and closes in it
    valid = classes.where(F.col("kinds").bitwiseAND(F.lit(3)) == 3)
    return valid.groupBy("host").agg(F.array_distinct(F.flatten(F.collect_list("roles"))).alias("roles"))


def extract_text(pages: DataFrame, *, url: str = "url", html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``pages`` (all but the html by default) and ``text``, the main text.

    A null or empty page has an empty text; a null URL belongs to the host without a name; broken
    markup is read as far as it goes; repeated pages get equal texts; an empty table stays empty; a
    column named ``text`` is replaced.
    """
    keep = [c for c in (keep or pages.columns) if c not in ("text", html)]
    found = cut_lineage(host_templates(pages, url=url, html=html), "templates").withColumnRenamed("host", "_host")
    hosts, held = found.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("roles")), F.lit(0))).first()
    if hosts <= BROADCAST_HOSTS and 8 * held <= BROADCAST_BYTES:
        found = F.broadcast(found)
    names = [f"_c{i}" for i in range(len(keep))]
    given = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], host_of(url).alias("_host"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("_html"))
    shape = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in given.schema if f.name in names)
    out = given.join(found, "_host", "left").mapInArrow(lambda it: extract(it, names), f"{shape}text string")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "text")
