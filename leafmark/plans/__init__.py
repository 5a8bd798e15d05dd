"""leafmark.plans"""
