from .expr import Expr, S, column, expr, let
from .paths import NodePath, node_path
from .text import tokenize, tokenized
from .tree import (
    TREE_TYPE,
    debug_text,
    has_children,
    is_defined,
    leaf_tree,
    name_at,
    name_in,
    name_is,
    rename_leaf,
    render,
    render_at,
    require_name,
    subtree,
    tree_from_json,
    tree_from_text,
    tree_from_text_shallow,
    update,
    update_in,
)
