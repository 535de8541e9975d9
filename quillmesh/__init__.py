"""quillmesh: notes retrieval and corpus analytics as DataFrame-to-DataFrame transformations."""
