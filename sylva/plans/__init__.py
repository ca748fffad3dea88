"""Logical plans over the node table: the tree model and the level-wise build."""

from .tree import CONTAINS, LT, Node, Rule, Tree, add_labels, label, label_subtree, publish

__all__ = ["CONTAINS", "LT", "Node", "Rule", "Tree", "add_labels", "label", "label_subtree", "publish"]
