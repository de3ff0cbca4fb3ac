"""The declared profile of a bundle: its page types, relation keys and folders. Small by nature; every operator takes it as a parameter."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PageType:
    """plural: heading in an index; folders: where its pages may live (`*`: any knowledge domain); required: keys on top of the common ones."""

    plural: str
    folders: tuple[str, ...] = ("*",)
    required: tuple[str, ...] = ()


@dataclass(frozen=True)
class Folder:
    """group: its group in the root index; sort: `date-desc` or none (inherited from above); auto_children: subfolders need no entry."""

    group: str = ""
    title: str = ""
    description: str = ""
    sort: str = ""
    auto_children: bool = False


@dataclass(frozen=True)
class Profile:
    types: dict[str, PageType] = field(default_factory=dict)
    relations: tuple[str, ...] = ()
    folders: dict[str, Folder] = field(default_factory=dict)
    root_groups: tuple[str, ...] = ()
    #: Keys known on top of the common profile.
    fields: tuple[str, ...] = ()
    #: Declared roots of `file:` locators, and globs of material that no locator may point at.
    roots: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()

    @property
    def domains(self) -> tuple[str, ...]:
        return tuple(f for f, s in self.folders.items() if "/" not in f and s.group == "Knowledge domains")

    @property
    def personal(self) -> tuple[str, ...]:
        return tuple(f for f, s in self.folders.items() if "/" not in f and s.group in ("Personal", "Vault"))

    def known(self, folder: str) -> bool:
        """Whether a folder has an entry of its own or through its parent."""
        above = self.folders.get(folder.rpartition("/")[0])
        return folder in self.folders or (above is not None and "/" in folder and above.auto_children)

    def sort_of(self, folder: str) -> str:
        """A folder's sort order: its own or that of the nearest folder above that has one."""
        while folder:
            if folder in self.folders and self.folders[folder].sort:
                return self.folders[folder].sort
            folder = folder.rpartition("/")[0]
        return ""


# The types, relation keys and groups of the house profile.
TYPES = {
    "Concept": PageType("Concepts"),
    "Practice": PageType("Practices"),
    "Comparison": PageType("Comparisons", ("*", "syntheses")),
    "Synthesis": PageType("Syntheses", ("syntheses",)),
    "Source": PageType("Sources", ("sources",), ("resource",)),
    "Person": PageType("People", ("entities",)),
    "Organization": PageType("Organizations", ("entities",)),
    "Project": PageType("Projects", ("projects",)),
    "Decision Record": PageType("Decision Records", ("projects",)),
    "Journal Entry": PageType("Journal Entries", ("journal",)),
    "Template": PageType("Templates", ("_templates",)),
}
RELATIONS = ("part_of", "depends_on", "example_of", "alternative_to", "supersedes", "contradicts", "related")
GROUPS = ("Knowledge domains", "Library", "Personal", "Vault")

#: The profile of the bundle in the test tables. It knows no practices and wants decisions verified, so that every rule about types finds pages.
HOUSE = Profile(
    types={**{n: t for n, t in TYPES.items() if n != "Practice"}, "Decision Record": PageType("Decision Records", ("projects",), ("verified",))},
    relations=RELATIONS,
    folders={
        "systems": Folder(GROUPS[0], "Systems", "Computers and networks.", "title"),
        "systems/network": Folder("", "Network", "", "name"),
        "data": Folder(GROUPS[0], "Data", "Formats and storage."),
        "operations": Folder(GROUPS[0], "Operations"),
        "methods": Folder(GROUPS[0], "Methods"),
        "sources": Folder(GROUPS[1], "Sources", "One summary page per source."),
        "syntheses": Folder(GROUPS[1], "Syntheses"),
        "library": Folder(GROUPS[1], "Library"),
        "journal": Folder(GROUPS[2], "Journal", "", "date-desc", True),
        "projects": Folder("", "Projects"),
    },
    root_groups=GROUPS,
    roots=("archive", "papers"),
    deny=("archive/private/**", "**/*.key"),
)
