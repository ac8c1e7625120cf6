"""Special functions and array algebra as Columns, with numpy twins."""
