"""sylva — decision-tree data analysis on Spark DataFrames.

Profile a table, grow an entropy-driven binary tree over it level by level,
emit the tree as a ``CASE`` column or SQL text that labels every row with its
leaf, validate it, and combine several trees into a class predictor — all as
DataFrame expressions planned by Catalyst.
"""

from .plans.tree import CONTAINS, LT, Node, Rule, Tree, add_labels, label, label_subtree

__all__ = ["CONTAINS", "LT", "Node", "Rule", "Tree", "add_labels", "label", "label_subtree"]
